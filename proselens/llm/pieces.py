"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda.

A text becomes symbols (code points, blanks as U+2581, one put before the text).  An agenda
holds all pairs of neighbouring symbols whose joint spelling is a piece, best score first and leftmost among equals;
the best pair that still stands is merged and the pairs with its new neighbours enter the agenda.  Symbols that are
no piece in the end become bytes, where the model has byte pieces, or else the unknown piece (neighbouring ones as
one).  Where no piece of the vocabulary reaches across, a text can be cut: before a blank after a non-blank, at a line
break, between a letter and a mark.  This is looked up when the vocabulary is read, and the answer for each word
between two cuts is kept in a bounded table, to be used again.

Models that normalise texts, put no blank before them, have pieces of the user or are of another type are not for this
agenda: a vocabulary is tried on texts that tell most of them apart when it is read, and refused if the library says
otherwise.  After that no row goes unchecked: the symbols of every text are compared with the library's ``normalize``,
and the agenda's ids of every word with the library's before they enter the table.  As no piece reaches across a cut,
words that agree make whole texts that agree.  Should anything differ, the vocabulary is refused with an error; ids of
the library never take the place of the agenda's.  Decoding is the library's ``decode``.

Defined cases: a null text counts as empty and has no ids; texts of any length are encoded whole, in n log n steps
for a single word of n symbols; repeated rows are encoded each; other columns are kept, but for those that are named as the results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import wordscan
from .common import table

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
KEEP_WORDS = 150_000
SHORT = 48
NEVER = float("inf")
LETTER = re.compile(r"[^\W\d_]")
TRIED = ["", " ", "a", "  two  blanks ", "Ａ ﬁ ½ é e\u0301 \u00a0x\u3000y", "tab\tand\nline\r\n", "the theme of these 1234.5 things, isn't it?", "日本語 \U0001f44d\U0001f3fd \x00", "<s> </s> <unk> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "▁x▁"]


def model_path(name: str = MODEL, folder: str | None = None) -> str:
    """The place of a vocabulary file: in ``folder``, or where the public_tokenizers package has it."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A merge-type vocabulary: encoding by the agenda, and the library itself for checks and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.rank, self.id, self.bytes, self.unknown = {}, {}, [None] * 256, lib.unk_id()
        unused = []
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif lib.is_unused(i):
                unused.append(piece)
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.id[piece] = i
                self.rank[piece] = -lib.get_score(i)
        self.has_bytes = None not in self.bytes
        self.cut = self.cutting([*self.id, *unused])
        self.head = lib.encode("\n")
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.digits = [str(i) for i in range(n)]
        for text in TRIED:
            if self.encode(text)[0] != lib.encode(text):
                self.refuse(text)

    def refuse(self, text: str) -> None:
        raise ValueError(f"{self.path} is no plain merge-type model: the library encodes {text[:200]!r} in another way")

    def cutting(self, pieces: list[str]) -> re.Pattern:
        """Words that can be encoded alone: cuts stand only where no piece of the vocabulary reaches across.

        Nor may unknown symbols, of which neighbouring ones are one piece: without byte pieces nothing is cut.
        """
        self.whole = not self.has_bytes or any(re.search(f"[^{BLANK}]{BLANK}", p) or (len(p) > 1 and "\n" in p) for p in pieces)
        if self.whole:
            return re.compile(".+", re.DOTALL)
        across = {p[i + 1] for p in pieces for i in range(len(p) - 1) if LETTER.match(p[i])}
        marks = "".join(re.escape(c) for c in ",.;:!?\"'()-%$#*&" if c not in across)
        after_letters = f"{BLANK}*{LETTER.pattern}++(?=[{marks}])|" if marks else ""
        return re.compile(f"{after_letters}{BLANK}*[^{BLANK}\n]++|{BLANK}+|\n")

    def merge(self, word: str) -> list[int]:
        """The ids of one word, by the agenda."""
        return self.numbers(self.short(word) if len(word) <= SHORT else self.long(word))

    def short(self, word: str) -> list[str]:
        """The merged symbols of a word of few symbols: the agenda is a list with the place of each pair."""
        rank = self.rank.get
        symbols = list(word)
        agenda = list(map(rank, map(add, word, word[1:]), repeat(NEVER)))
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            joint = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = [joint]
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + joint, NEVER)
            if i < len(agenda):
                agenda[i] = rank(joint + symbols[i + 1], NEVER)
        return symbols

    def long(self, word: str) -> list[str]:
        """The merged symbols of a word of any length: the agenda is a heap, and outdated pairs are passed over."""
        symbols: list[str | None] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                joint = symbols[a] + symbols[b]
                if (r := self.rank.get(joint)) is not None:
                    heapq.heappush(agenda, (r, a, b, joint))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, joint = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or after[a] != b or len(symbols[a]) + len(symbols[b]) != len(joint):
                continue
            symbols[a], symbols[b] = joint, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s is not None]

    def numbers(self, symbols: list[str]) -> list[int]:
        """The ids of symbols that are merged no more."""
        ids: list[int] = []
        for s in symbols:
            if (i := self.id.get(s)) is not None:
                ids.append(i)
            elif self.has_bytes:
                ids.extend(self.bytes[x] for x in s.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids of a text, and the same as decimal numbers with commas."""
        if not text:
            return [], ""
        spelled = BLANK + text.replace(" ", BLANK)
        if self.library.normalize(text) != spelled:
            self.refuse(text)
        words = self.cut.findall(spelled)
        got = list(map(self.kept.get, words))
        if None in got:
            answers = self.answers(dict.fromkeys(w for w, found in zip(words, got) if found is None))
            got = [answers[w] if found is None else found for w, found in zip(words, got)]
        ids = list(chain.from_iterable(got))
        return ids, ",".join(map(self.digits.__getitem__, ids))

    def answers(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of words not in the table of the latest ones; two tables take turns, so that memory is bounded."""
        got = {w: self.older.get(w) for w in words}
        new = [w for w, found in got.items() if found is None]
        for w in new:
            got[w] = tuple(self.merge(w))
        if new:
            self.check(new, [got[w] for w in new])
        for w, ids in got.items():
            if len(w) <= SHORT:
                if len(self.kept) >= KEEP_WORDS:
                    self.kept, self.older = {}, self.kept
                self.kept[w] = ids
        return got

    def check(self, words: list[str], answers: list[tuple[int, ...]]) -> None:
        """Compares the ids of each word with the library's, which puts a blank before the text that it is given.

        So words are given to it with a line break before each, where cuts are; a text that is not cut has that blank.
        """
        if self.whole:
            agree = all(self.library.encode(w[1:]) == [*ids] for w, ids in zip(words, answers))
        else:
            first, *line = self.head
            ids = [first, *chain.from_iterable((*line, *ids) for ids in answers)]
            agree = self.library.encode("".join(["\n" + w for w in words])) == ids
        if not agree:
            self.refuse("".join(words))


@lru_cache(2)
def load(path: str) -> Pieces:
    """The vocabulary at a path, read once a worker."""
    return Pieces(path)


def tokens(docs: DataFrame, path: str | None = None, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Every row of ``docs`` as (the columns ``keep``, by default all; ids array<int>, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or model_path()
    made = ["ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    names = [c for c in keep or docs.columns if c not in made]
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([*(docs.schema[c] for c in names), *extra])

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in wordscan.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                got = [model.encode(t) for t in texts]
                columns = [part.column(c) for c in names]
                if with_ids:
                    columns.append(pa.array([ids for ids, _ in got], pa.list_(pa.int32())))
                columns += [
                    pa.array([len(ids) for ids, _ in got], pa.int64()),
                    pa.array([sha(written) for _, written in got], pa.string()),
                    pa.array([sha(model.library.decode(ids)) for ids, _ in got], pa.string()),
                ]
                yield pa.record_batch(columns, names=[*names, *made])
        model.kept, model.older = {}, {}  # the worker lives on with other tasks

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(work, schema)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``."""
    return tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], with_ids=False)
