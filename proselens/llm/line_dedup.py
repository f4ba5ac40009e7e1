"""Line dedup by a deletion-neighbourhood join, with built-in functions only.

A line is a run of text between line feeds, and its content is its words (split at blanks, tabs and the like).  Two
lines are near when their word edit distance is at most one (a word replaced, added or removed) and both have
``min_words`` or more; shorter lines must be equal (by default 8, as "Part 1" and "Part 2" are no copies; any other
number may be asked for).  A line goes if an earlier line equals it or is near to it; "earlier" is by document id, then
by line number, and also a line that goes itself counts.  Lines without words stay.

1. Equal lines: occurrences are counted into distinct lines by two 64-bit hashes, each with its earliest place.
2. Coarse keys: a line is thought of as four blocks of words, counted from its start and from its end.  One edit stands
   in one of them, so lines one edit apart agree on the other three: a line has one key for each three blocks.
   Distinct lines that share no key with another line are done.
3. Neighbourhood: within the block that a shared key leaves open, a line emits the hashed key of every variant with
   one word deleted, and of the gaps where another line may have a word more: a key is the hash of what stands before
   the place and of what stands after it.  Hashes of runs of words are reused, so that a line of n words costs about
   n * (n / BLOCK + BLOCK), not n * n.  Lines of one key are all within one edit of each other, so each is compared
   with the earliest of them, not with all; how many lines it is linked to follows from the counts of each key.
4. Verification: of a line and the earliest of a key, the words before the place and after it are compared.
5. What remains of each document is put together again.

No step takes all rows of one key: counts and minima are aggregated before the shuffle, the most common lines (those
that make up more than a ``HOT``-th of all, so at most that many) are judged by a broadcast, and the joins are plain
equi-joins that are divided when skewed.  Texts are shuffled at most twice.

Defined cases: a null text counts as empty and stays null; an empty text stays; a document of which every line goes
is returned with an empty text (``deduplicated`` tells it by n_kept = 0 and n_removed > 0, ``clean`` leaves it out);
rows that are equal in id and text are treated alike, and lines at the same place of rows of one id are equally early;
rows without id are before all others, in the order of a hash of their texts; very long lines are compared whole; other
columns are kept (``deduplicated`` replaces those that are named as its counts); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, fresh, table

MIN_WORDS = 8
BLOCK = 32
STEP = 8
_SPACE = " \t\r\x0b\x0c"
_PLACE = "decimal(38,0)"
_LINES = 10**10
HOT = 20_000


def _even(text: Column) -> Column:
    """A text with one blank between words and none at the ends of lines; it has the same number of lines."""
    uneven = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for mark in (*_SPACE[1:], "  ", " \n", "\n "):
        uneven |= F.contains(text, F.lit(mark))
    single = F.regexp_replace(text, f"[{_SPACE}]+", " ")
    return F.when(uneven, F.regexp_replace(single, "(?<![^\\n]) | (?![^\\n])", "")).otherwise(text)


def _with_keys(lines: DataFrame) -> DataFrame:
    """Lines with n (their words) and coarse keys k0 to k7, null where there are none.

    The last four are for lines whose length begins a new block size, with the size before.  First and last words are
    taken as parts of the line, by its blanks, without making words of it.
    """
    n, bare = F.col("n"), F.col("bare")
    counted = lines.withColumn("n", (F.length("bare") - F.length(F.replace("bare", F.lit(" "), F.lit(""))) + 1).cast("int"))
    families = ((0, n, n >= MIN_WORDS), (4, n - 1, (n % STEP == 0) & (n > MIN_WORDS)))
    hashes, keys = {}, {}
    for base, m, there in families:
        for k in (1, 2, 3):
            for side, sign in (("p", 1), ("s", -1)):
                part = F.call_function("substring_index", bare, F.lit(" "), _block(m) * (k * sign))
                hashes[f"{side}{base + k}"] = F.when(there, F.xxhash64(part))
        for j in range(4):
            ends = [F.col(f"p{base + j}")] * (j > 0) + [F.col(f"s{base + 3 - j}")] * (j < 3)
            keys[f"k{base + j}"] = F.when(there, F.xxhash64(F.lit(j), _block(m), *ends))
    return counted.withColumns(hashes).withColumns(keys).drop(*hashes)


def _block(n: Column) -> Column:
    """The words in each of three blocks of a line of n words; the fourth has the rest.  The same over runs of n."""
    return F.floor(n / STEP).cast("int") * 2


def _order(doc_id: Column, t: Column, line_no: Column) -> Column:
    """Where a line stands among all, as one number; rows without id are before all others, by the hash of the text."""
    none = F.lit(-(2**63)).cast("decimal(20,0)") - 1 - F.pmod(t, F.lit(2**62)).cast("decimal(19,0)")
    return (F.coalesce(doc_id.cast("decimal(20,0)"), none) * F.lit(_LINES).cast("decimal(11,0)") + line_no).cast(_PLACE)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, t, line_no, bare, h, g): all lines with words; t: hash of the text, h and g: hashes of the line's words."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(_even(F.col("text")), "\n")).alias("line_no", "bare"))
    return lines.where("bare <> ''").withColumns({"h": F.xxhash64("bare"), "g": F.xxhash64(F.lit(7), "bare")})


def _variants(w: Column, n: Column, first: Column, last: Column) -> Column:
    """Keys for the places first to last of a line: (key, place, gone) with the word there deleted, (key, place, 0) with none.

    gone is 1, or 2 where the word before is the same: deleting either leaves the same words, and a line that has one
    of them less meets this one in both keys, so that only the first is counted as a link.
    """
    blocks = F.floor(n / BLOCK).cast("int")

    def made(k: Column, at) -> Column:
        return F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), at)).otherwise(F.array().cast("array<bigint>"))

    heads = made(blocks, lambda b: F.xxhash64(F.slice(w, b * BLOCK + 1, BLOCK)))
    tails = made(blocks, lambda b: F.xxhash64(F.slice(w, n - (b + 1) * BLOCK + 1, BLOCK)))

    def keyed(blocked: Column) -> Column:
        head, tail = blocked["heads"], blocked["tails"]

        def before(i: Column) -> Column:
            k = F.floor(i / BLOCK).cast("int")
            return F.xxhash64(i, F.slice(head, 1, k), F.slice(w, k * BLOCK + 1, i - k * BLOCK))

        def after(m: Column) -> Column:
            k = F.floor(m / BLOCK).cast("int")
            return F.xxhash64(m, F.slice(tail, 1, k), F.slice(w, n - m + 1, m - k * BLOCK))

        def at(i: Column) -> Column:
            gap = F.struct(F.xxhash64(before(i), after(n - i)).alias("key"), i.alias("place"), F.lit(0).alias("gone"))
            gone = F.struct(F.xxhash64(before(i), after(F.greatest(n - i - 1, F.lit(0)))).alias("key"), i.alias("place"), F.when(F.get(w, i) == F.get(w, i - 1), 2).otherwise(1).alias("gone"))
            return F.when(i < n, F.array(gap, gone)).otherwise(F.array(gap))

        return F.flatten(F.transform(F.sequence(first, last), at))

    return F.flatten(F.transform(F.array(F.struct(heads.alias("heads"), tails.alias("tails"))), keyed))


def _near(docs: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """(h, g, links, near): distinct lines, how many others are within one edit, and whether one of these is earlier."""
    n = F.col("n")
    opened = []
    for i in range(8):
        b = _block(n if i < 4 else n - 1)
        opened.append(F.struct(F.col(f"k{i}").alias("key"), (b * (i % 4)).alias("low"), (n - b * (3 - i % 4)).alias("high")))
    long = distinct.where(n >= max(min_words, MIN_WORDS))
    keys = long.select("h", F.explode(F.when(F.col("k4").isNull(), F.array(*opened[:4])).otherwise(F.array(*opened))).alias("o")).select("h", "o.*")
    shared = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    spans = keys.join(shared.hint("shuffle_hash"), "key").select("h", "low", "high")
    if min_words < MIN_WORDS:  # lines too short for coarse keys are open throughout
        short = distinct.where((n >= min_words) & (n <= MIN_WORDS))
        spans, long = spans.unionByName(short.select("h", F.lit(0).alias("low"), n.alias("high"))), distinct.where(n >= min_words)
    hit = spans.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).join(long.select("h", "g", "place"), "h")
    doc = F.floor(F.col("place") / F.lit(_LINES).cast("decimal(11,0)")).cast(_PLACE)
    hit = hit.withColumn("c_doc", doc).withColumn("line_no", (F.col("place") - doc * _LINES).cast("int"))
    wanted = hit.groupBy("c_doc").agg(F.collect_list(F.struct("line_no", "h", "g", "place", "low", "high")).alias("wanted"))
    texts = docs.select("text", F.floor(_order(F.col("doc_id"), F.xxhash64("text"), F.lit(0)) / F.lit(_LINES).cast("decimal(11,0)")).cast(_PLACE).alias("c_doc"))

    def picked(lines: Column) -> Column:  # the text is split once, not once for each line that is wanted
        return F.transform("wanted", lambda x: F.struct(*(x[c].alias(c) for c in ("h", "g", "place", "low", "high")), F.get(lines, x["line_no"]).alias("bare")))

    found = texts.join(wanted, "c_doc").select(F.inline(F.flatten(F.transform(F.array(F.split(_even(F.col("text")), "\n")), picked)))).where(F.xxhash64("bare") == F.col("h"))
    once = found.dropDuplicates(["h", "g"])  # rows that repeat id and text give each line as often
    lines = cut(once.select("h", "g", "place", "low", "high", F.split("bare", " ").alias("w")), "lines")
    variants = cut(lines.select("h", "g", F.inline(_variants(F.col("w"), F.size("w"), F.col("low"), F.col("high")))), "variants")
    several = variants.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    met = cut(variants.join(several.hint("shuffle_hash"), "key"), "members")
    drop(variants)
    members = met.join(lines.select("h", "g", F.col("place").alias("at")), ["h", "g"])
    gone = F.col("gone")
    counts = members.groupBy("key").agg(F.min(F.struct("at", "h", "g", "gone")).alias("e"), F.count_if(gone > 0).alias("n_gone"), F.count_if(gone == 1).alias("n_first"), F.count_if(gone == 0).alias("n_gap"))
    links = F.when(gone == 0, F.col("n_first")).otherwise(F.col("n_gone") - 1 + F.when(gone == 1, F.col("n_gap")).otherwise(0))
    to = F.struct(F.col("e.h").alias("eh"), F.col("e.g").alias("eg"), "place", "gone", F.col("e.gone").alias("e_gone"))
    linked = cut(members.join(counts, "key").groupBy("h", "g").agg(F.sum(links).alias("links"), F.collect_set(F.when(F.col("e.h") != F.col("h"), to)).alias("to")), "linked")
    drop(met)
    pairs = linked.select("h", "g", F.inline("to"))
    mine, other = lines.select("h", "g", "w"), lines.select(F.col("h").alias("eh"), F.col("g").alias("eg"), F.col("w").alias("ew"))

    def rest(w: Column, gone: Column) -> Column:
        return F.slice(w, F.col("place") + 1 + F.least(gone, F.lit(1)), F.size(w))

    same = (F.slice("w", 1, F.col("place")) == F.slice("ew", 1, F.col("place"))) & (rest(F.col("w"), F.col("gone")) == rest(F.col("ew"), F.col("e_gone")))
    near = pairs.join(mine, ["h", "g"]).join(other, ["eh", "eg"]).where(same).select("h", "g", F.lit(True).alias("near")).distinct()
    out = cut(linked.select("h", "g", "links").join(near, ["h", "g"], "left").select("h", "g", "links", F.coalesce("near", F.lit(False)).alias("near")), "links")
    drop(linked), drop(lines)
    return out


def _counted(docs: DataFrame, min_words: int) -> tuple[DataFrame, list[str]]:
    """Every row of ``docs`` with its text less the lines that go, and counts in columns of the names returned."""
    filled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    every = cut(_with_keys(_occurrences(filled)).select("doc_id", "t", "line_no", "h", "g", "n", *(f"k{i}" for i in range(8))), "occurrences")
    placed = every.withColumn("place", _order(F.col("doc_id"), F.col("t"), F.col("line_no"))).drop("doc_id", "t", "line_no")
    distinct = cut(placed.groupBy("h", "g").agg(F.min("place").alias("place"), F.count("*").alias("times"), *(F.max(c).alias(c) for c in ("n", *(f"k{i}" for i in range(8))))), "distinct")
    near = _near(filled, distinct, min_words)
    judged = distinct.select("h", "g", F.col("place").alias("first"), "times").join(near, ["h", "g"], "left").where("near or links > 0 or times > 1")
    judged = cut(judged, "judged")
    drop(distinct)
    common = F.col("times") > max(1, every.count() // HOT)
    hot = F.broadcast(judged.where(common).drop("times"))
    found = every.select("doc_id", "t", "line_no", "h", "g")
    met = found.join(hot, ["h", "g"]).unionByName(found.join(hot, ["h", "g"], "left_anti").join(judged.where(~common).drop("times"), ["h", "g"]))
    again = _order(F.col("doc_id"), F.col("t"), F.col("line_no")) != F.col("first")
    text_hash, g_id, g_t, gone, n_lines, n_kept, n_removed, n_near, n_links = fresh(docs, "t", "g_id", "g_t", "gone", "lines", "kept", "removed", "near", "links")
    near_first = F.col("near") & ~again
    judgement = (
        met.groupBy(F.col("doc_id").alias(g_id), F.col("t").alias(g_t))
        .agg(  # sets, as rows that repeat id and text give each line as often
            F.collect_set(F.when(F.col("near") | again, F.col("line_no"))).alias(gone),
            F.collect_set(F.when(near_first, F.col("line_no"))).alias(n_near),
            F.collect_set(F.when((F.col("links") > 0) & ~again, F.struct("line_no", "links"))).alias(n_links),
        )
        .withColumns({n_near: F.size(n_near), n_links: F.aggregate(n_links, F.lit(0).cast("long"), lambda total, x: total + x["links"])})
    )
    rows = docs.withColumn(text_hash, F.xxhash64(F.coalesce("text", F.lit("")))).join(judgement, (F.col(text_hash) == F.col(g_t)) & F.col("doc_id").eqNullSafe(F.col(g_id)), "left")
    kept = F.when(F.size(F.coalesce(gone, F.array().cast("array<int>"))) == 0, F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n"))
    with_words = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(_SPACE)) != ""))
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(with_words).cast("long")
    removed = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    made = [n_lines, n_kept, n_removed, n_near, n_links]
    counts = [lines, lines - removed, removed, F.coalesce(n_near, F.lit(0)).cast("long"), F.coalesce(n_links, F.lit(0)).cast("long")]
    return rows.select(*(kept.alias("text") if c == "text" else F.col(c) for c in docs.columns), *(x.alias(c) for x, c in zip(counts, made, strict=True))), made


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with its text less the lines that go, and n_lines, n_kept, n_removed, n_near, n_links.

    n_lines counts lines with words, n_near those removed as near to an earlier line only.  n_links is the links of the
    lines that stand first in this row: for each, how many other lines, earlier or later, are within one edit of it (a
    line that stands at several places counts once), so that the sum over all rows is twice the number of links.  Links
    are counted by keys of 64 bits; that a line goes is always verified by its words.
    """
    found, made = _counted(docs, min_words)
    names = ["n_lines", "n_kept", "n_removed", "n_near", "n_links"]
    return found.select(*(c for c in docs.columns if c not in names), *(F.col(m).alias(c) for m, c in zip(made, names, strict=True)))


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, with their texts less the lines that go; a row of which every line went is left out."""
    found, (_, kept, removed, _, _) = _counted(docs, min_words)
    return found.where(~((F.col(kept) == 0) & (F.col(removed) > 0))).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each of ``documents``."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_kept", "n_removed", "n_near", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
