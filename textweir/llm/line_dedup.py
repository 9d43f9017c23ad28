"""Line dedup by a suffix array of line sequences, built by distributed prefix doubling, with DataFrame operations only.

1. A document is its sequence of line ids (64-bit hashes of its non-blank lines). Lines that stand in one place only
   cannot repeat, so a document falls into *segments*: its longest stretches of lines that occur at least twice in the
   corpus, and of at least ``min_words`` words. Of equal segments the first in (doc_id, line) order is searched on, all
   others are later copies as a whole.
2. Prefix doubling: every suffix of a segment is ranked by its first line, then by its first 2, 4, ... lines, until no
   run is longer. A level names the pairs (rank here, rank 2^k lines on) by their place in a distributed sort, so ranks
   are dense and keep the order: the last level's are the suffix array, up to the length of the longest run.
3. Neighbours in the suffix array are compared for the length of their longest common prefix. Where it is shorter than a
   suffix's shortest run of ``min_words`` words, a new interval begins; an interval's suffixes share that run, and of its
   places the first stays.
4. Segments are read backward too, in symbols of their own, which gives the runs up to each end, so that a repeated run
   goes to its last line. Runs of one document that overlap or touch are merged: these are the maximal repeated runs, and
   they are deleted.

Intervals are pre-aggregated to their first place and joined back from tables, so a run that a third of all documents
share is split over tasks; sorts are by range with offsets, so no task holds a whole group. Null and empty texts have no
lines to remove; blank lines go only inside a removed run; rows that repeat a doc_id and text are treated alike (at the
same place, neither is the later copy); null ids sort first; other columns pass through, also with clashing names; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, materialise, reclaim, shuffle_parts

MIN_WORDS = 50
#: More than the lines of a document, whose number is an int.
_STEP = 1 << 31
_KEYS = ["_tw_doc", "_tw_hash"]
#: Neighbours of the suffix array that are looked through together for the start of their interval.
_BLOCK = 50_000


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("_tw_doc", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_tw_hash", F.xxhash64("text"))


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _place(line: Column) -> Column:
    return (F.col("_tw_doc").cast("decimal(20,0)") * F.lit(_STEP).cast("decimal(10,0)") + line).cast("decimal(38,0)")


def segments(documents: DataFrame, min_words: int) -> DataFrame:
    """Stretches of repeated lines of at least ``min_words`` words: keys, name, place and lines (i, h, w words, c words so far)."""
    d = _keyed(documents.select("doc_id", "text"))
    line = lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))
    ids = d.select(F.explode(F.transform(_lines(), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(x)))).alias("h")).where("h is not null")
    repeated = materialise(ids.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "repeated")
    rows = d.select(*_KEYS, F.posexplode(F.filter(F.transform(_lines(), line), lambda x: x["w"] > 0)).alias("j", "x")).select(*_KEYS, "j", "x.*")
    rows = rows.join(repeated, "h", "left_semi").dropDuplicates([*_KEYS, "j"])
    w = Window.partitionBy(*_KEYS).orderBy("j")
    rows = rows.withColumns({"_first": F.col("j") - F.row_number().over(w), "c": F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    found = rows.groupBy(*_KEYS, "_first").agg(F.array_sort(F.collect_list(F.struct("i", "h", "w", "c"))).alias("lines"), F.sum("w").alias("words")).where(F.col("words") >= min_words)
    name = F.xxhash64(F.transform("lines", lambda x: x["h"]))
    return found.select(*_KEYS, name.alias("name"), _place(F.col("lines")[0]["i"]).alias("place"), "lines")


def _numbered(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Rows with their place in the order of ``by``, from 0: sorted by range, numbered inside a range, shifted by the ranges before."""
    dealt = df.repartitionByRange(shuffle_parts(df.sparkSession), *by).sortWithinPartitions(*by)
    dealt = materialise(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sorted")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as ranges
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(number, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def suffix_ranks(suffixes: DataFrame, longest: int) -> DataFrame:
    """(s, j, r) of suffixes (s sequence, j, h line id): their order by at least ``longest`` lines. An end ranks lowest."""
    ranks = suffixes.select("s", "j", F.col("h").alias("r"))
    for k in range(math.ceil(math.log2(max(1, longest)))):
        w = Window.partitionBy("s").orderBy("j")
        pairs = materialise(ranks.withColumn("x", F.coalesce(F.lead("r", 1 << k).over(w), F.lit(-(2**63)))), "pairs")
        ranks = pairs.join(_numbered(pairs.select("r", "x").distinct(), ["r", "x"], "name"), ["r", "x"]).select("s", "j", F.col("name").alias("r"))
    return ranks


def _directed(found: DataFrame, min_words: int) -> DataFrame:
    """A row per line of every segment, read forward and backward: s sequence, j place in it, h line id of that direction, and
    the shortest run of ``min_words`` words from there: its lines (start, stop), their number n (null: too few words) and
    ids (head)."""
    both = [found.select(*_KEYS, F.xxhash64(*_KEYS, "place", F.lit(back)).alias("s"), F.lit(back).alias("back"), (F.reverse("lines") if back else F.col("lines")).alias("lines")) for back in (False, True)]
    seqs = materialise(both[0].unionAll(both[1]), "directed")  # what follows looks into the array by place: it must be a column
    words = lambda x, y: F.when(F.col("back"), x["c"] - y["c"] + y["w"]).otherwise(y["c"] - x["c"] + x["w"])
    number = lambda x, j: F.nullif(F.array_position(F.transform(F.slice("lines", j + 1, min_words), lambda y: words(x, y) >= min_words), True), F.lit(0)).cast("int")
    symbol = lambda x: F.when(F.col("back"), F.xxhash64(x["h"])).otherwise(x["h"])
    rows = seqs.select(*_KEYS, "s", "back", "lines", F.explode(F.transform("lines", lambda x, j: F.struct(j.alias("j"), symbol(x).alias("h"), x["i"].alias("i"), number(x, j).alias("n")))).alias("x"))
    rows = rows.select(*_KEYS, "s", "x.*", F.transform(F.slice("lines", F.col("x.j") + 1, F.coalesce("x.n", F.lit(0))), symbol).alias("head"), F.col("lines")[F.col("x.j") + F.col("x.n") - 1]["i"].alias("e"))
    return rows.withColumns({"start": F.least("i", "e"), "stop": F.greatest("i", "e")}).drop("i", "e")


def _later(found: DataFrame, min_words: int) -> DataFrame:
    """(keys, start, stop) of the shortest runs from a line, and up to a line, that an earlier place has too."""
    rows = materialise(_directed(found, min_words), "suffixes")
    longest = rows.agg(F.max("n")).first()[0]
    if longest is None:
        return rows.select(*_KEYS, "start", "stop").limit(0)
    runs = rows.where("n is not null").join(suffix_ranks(rows, longest), ["s", "j"])
    runs = materialise(runs.select(*_KEYS, "start", "stop", "n", "head", "r", _place(F.col("start")).alias("place")), "runs")
    array = runs.groupBy("r").agg(F.min("place").alias("place"), F.max("place").alias("last"), F.min("n").alias("n"), F.first("head").alias("head"), F.count("*").alias("c"))
    array = _numbered(array, ["r"], "at").withColumn("block", F.floor(F.col("at") / _BLOCK))
    # a block's last row stands in the next block too, as the neighbour of its first
    array = array.withColumn("block", F.explode(F.when(F.col("at") % _BLOCK == _BLOCK - 1, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))))
    w = Window.partitionBy("block").orderBy("at")
    differs = F.array_position(F.zip_with("head", F.lag("head").over(w), lambda x, y: x.eqNullSafe(y)), False)
    array = array.withColumn("lcp", F.coalesce(F.when(differs > 0, differs - 1), F.when(differs == 0, F.col("n")), F.lit(0)))
    array = array.where(F.floor(F.col("at") / _BLOCK) == F.col("block")).withColumn("opens", F.when(F.col("lcp") < F.col("n"), F.col("at")))
    array = materialise(array.withColumn("own", F.last("opens", True).over(w)).drop("head"), "suffix_array")
    carried = array.groupBy("block").agg(F.max("opens").alias("most")).select("block", F.max("most").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    member = array.join(carried, "block").select("r", "place", "last", "c", F.coalesce("own", "carried").alias("interval"))
    intervals = member.groupBy("interval").agg(F.min("place").alias("first"), F.max("last").alias("last")).where("last > first")
    firsts = materialise(member.join(intervals.select("interval", "first"), "interval").select("r", "first", "c"), "firsts")
    return materialise(joined(runs.drop("head"), firsts, "r").where("place > first").select(*_KEYS, "start", "stop"), "later")


def removed_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document with later copies: its merged runs of lines to remove, ``_tw_runs`` array<struct<start, stop>>."""
    found = materialise(segments(documents, min_words), "segments")
    firsts = materialise(found.groupBy("name").agg(F.min("place").alias("first"), F.count("*").alias("c")), "firsts")
    found = materialise(joined(found, firsts, "name"), "segments")
    once = found.where("place = first")
    later = found.where("place > first").select(*_KEYS, F.col("lines")[0]["i"].alias("start"), F.element_at("lines", -1)["i"].alias("stop"))
    later = later.unionAll(_later(once, min_words))
    reclaim(documents.sparkSession)
    w = Window.partitionBy(*_KEYS).orderBy("start", "stop")
    later = later.groupBy(*_KEYS, "start").agg(F.max("stop").alias("stop"))
    later = later.withColumn("_before", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("_run", F.sum(F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before") + 1), 1).otherwise(0)).over(w))
    runs = later.groupBy(*_KEYS, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return materialise(runs.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_tw_runs")), "removed")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with ``text`` less the later copies of repeated runs, and ``_tw_lines``, ``_tw_removed`` line counts."""
    # the runs grow with the documents: joined by a shuffle at every size
    d = _keyed(documents).join(removed_runs(documents, min_words).hint("merge"), _KEYS, "left")
    stays = lambda r, k: F.concat(F.array_repeat(F.lit(True), r["start"] - F.coalesce(F.get("_tw_runs", k - 1)["stop"] + 1, F.lit(0))), F.array_repeat(F.lit(False), r["stop"] - r["start"] + 1))
    kept = F.array_join(F.zip_with(_lines(), F.flatten(F.transform("_tw_runs", stays)), lambda x, f: F.when(F.coalesce(f, F.lit(True)), x)), "\n")
    lines = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(_lines()))
    removed = F.aggregate(F.coalesce("_tw_runs", F.expr("cast(array() as array<struct<start:int,stop:int>>)")), F.lit(0), lambda a, r: a + r["stop"] - r["start"] + 1)
    return d.withColumns({"_tw_lines": lines, "_tw_removed": removed, "text": F.when(F.col("_tw_runs").isNull(), F.col("text")).otherwise(kept)}).drop(*_KEYS, "_tw_runs")


def op5(documents: DataFrame) -> DataFrame:
    return dedup_lines(documents.select("doc_id", "text")).select("doc_id", F.col("_tw_lines").alias("n_lines"), F.col("_tw_removed").alias("n_removed"), "text")


def drop_emptied(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The table with later copies of repeated runs deleted; documents left with nothing go."""
    out = dedup_lines(documents, min_words)
    return out.where((F.col("_tw_removed") == 0) | (F.trim("text") != "")).select(documents.columns)


ORACLE = r"""
with l as (select row_number() over () as k, doc_id, text, string_split(coalesce(text, ''), chr(10)) as t from documents),
x as (select k, doc_id, unnest(range(0, len(t))) as i, unnest(t) as line from l),
y as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from x),
z as (select *, sum(w) over (partition by k order by i) as c from y where w > 0),
f as (select a.k, a.doc_id, a.i as s, min(b.i) as e from z a join z b on a.k = b.k and b.i >= a.i and b.c - (a.c - a.w) >= 50 group by all),
g as (select b.k, b.doc_id, max(a.i) as s, b.i as e from z a join z b on a.k = b.k and b.i >= a.i and b.c - (a.c - a.w) >= 50 group by all),
r as (select * from f union select * from g),
c as (select r.k, r.doc_id, s, e, string_agg(line, chr(10) order by i) as body from r join z on z.k = r.k and z.i between s and e group by all),
m as (select body, min(coalesce(doc_id, -9000000000000) * 1000000 + s) as first from c group by body),
gone as (select distinct x.k, x.i from c join m using (body) join x on x.k = c.k and x.i between c.s and c.e where coalesce(c.doc_id, -9000000000000) * 1000000 + c.s > m.first),
kept as (select k, string_agg(line, chr(10) order by i) as t from x where not exists (select 1 from gone where gone.k = x.k and gone.i = x.i) group by k),
n as (select k, count(*) as n from gone group by k)
select l.doc_id, (case when l.text is null or l.text = '' then 0 else len(l.t) end)::int as n_lines, coalesce(n.n, 0)::int as n_removed, case when n.n is null then l.text else coalesce(kept.t, '') end as text
from l left join n using (k) left join kept using (k)
"""
