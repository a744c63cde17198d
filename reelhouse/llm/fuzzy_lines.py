"""Fuzzy line dedup by MinHash, with built-in functions only.

Equal lines become one row by their 128-bit hash (aggregated before the shuffle, so a line that
sits in a third of all documents is a few rows). A line's set is all its overlapping shingles of
``SHINGLE`` characters (a shorter line is one), whatever its script, with or without blanks. Its
signature is ``HASHES`` minima over that set, made in one pass: every ``RUN`` consecutive shingles are a row whose hashes go into
minima and maxima of their differently flipped forms, which each task adds up per line before anything moves. A band is
three of them, and lines that are 0.8 similar share one of the ``BANDS`` bands nearly always (98 to 99.6 percent, the
tests measure it). Lines that share a band must pass the size bound and a parity bound (bits in
which hashed parities of the sets differ are a lower bound of their difference; 128 bits for the
first pairs, 1,024 for those across components), then the exact
Jaccard similarity of the sets, at least ``PERCENT`` / 100. The links become components by
distributed union-find (``clusters``). Of a component's occurrences the first stays (least
doc_id, then line number, then text hash), all others go.

Texts move once, to fetch the lines that share a band.

Defined cases: blank lines (nothing but white space) always stay and are never compared; null
text has no lines and stays null; a text that loses all its lines becomes empty; rows that
repeat a doc_id and text are judged alike (both keep a first occurrence); other columns pass
through, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .clusters import forget, link_buckets

SHINGLE, HASHES, BANDS, PERCENT = 8, 16, 8, 80
#: Consecutive shingles that are one row while signatures are made.
RUN = 8
#: Words of 64 bits in a set's parity.
WORDS = 16
_NO_ID = -(1 << 63)


def _last(b: str) -> str:
    """Place of the last shingle of a line, whose code points ``b`` holds at four bytes each (so that
    a shingle is cut out without a walk along the line): places are bytes from 1, four apart."""
    return f"greatest(4 * cast(octet_length({b}) div 4 as int) - {4 * SHINGLE - 1}, 1)"


def _shingle(b: str, i: str) -> str:
    return f"xxhash64(substring({b}, {i}, {4 * SHINGLE}))"


def _hashes(line: str) -> Column:
    """Hashes of the line's shingles, in order (repeats included)."""
    return F.expr(f"transform(array(encode({line}, 'UTF-32')), b -> transform(sequence(1, {_last('b')}, 4), i -> {_shingle('b', 'i')}))[0]")


def _orders(*hs: str) -> list[Column]:
    """Aggregates: least and greatest of the hashes ``hs`` in differently flipped orders (the
    greatest value in one order is the least one with all bits flipped)."""
    def flipped(j):  # flipping bits reorders the hashes; the leading ones differ for each j
        flip = (j << 60) | (j * 0x0123456789ABCDF & (1 << 60) - 1)
        return [F.col(h).bitwiseXOR(F.lit(flip).cast("long")) for h in hs]

    def one(pick, each):  # of a row
        return pick(*each) if len(each) > 1 else each[0]

    half = HASHES // 2
    return [F.min(one(F.least, flipped(j))).alias(f"v{j}") for j in range(half)] + [
        F.max(one(F.greatest, flipped(half - 1 - j))).alias(f"v{half + j}") for j in range(half)]


def _bands() -> Column:
    """Band hashes of the minima ``v0``, ``v1``, ..."""
    return F.array(*[F.xxhash64(F.lit(b), *[F.col(f"v{(2 * b + k) % HASHES}") for k in (0, 1, 6)]) for b in range(BANDS)])


def _signed(docs: DataFrame) -> DataFrame:
    """(l1, l2, bands) of the distinct lines."""
    def parts(line):
        return F.struct(F.xxhash64(line).alias("l1"), F.xxhash64(F.lit(1), line).alias("l2"), F.encode(line, "UTF-32").alias("b"),
                        line.rlike(r"\S").alias("live"))

    each = docs.select(F.explode(F.transform(F.split("text", "\n", -1), parts)).alias("s")).filter("s.live").select("s.l1", "s.l2", "s.b")
    ends = each.withColumn("last", F.expr(_last("b")))
    runs = ends.select("l1", "l2", "b", "last", F.explode(F.expr(f"sequence(1, last, {4 * RUN})")).alias("i"))
    names = [f"h{k}" for k in range(RUN)]  # the last run repeats the last shingle, which changes no minimum
    hashed = runs.select("l1", "l2", *[F.expr(_shingle("b", f"least(i + {4 * k}, last)")).alias(h) for k, h in enumerate(names)])
    return hashed.groupBy("l1", "l2").agg(*_orders(*names)).select("l1", "l2", _bands().alias("bands"))


def _parities(texts: DataFrame) -> DataFrame:
    """(id, n: set size, p0, p1, ...: the set's parity, a bit for each value of ten low bits) of
    lines (id, line)."""
    h = texts.select("id", F.array_distinct(_hashes("line")).alias("s")).select("id", F.explode("s").alias("h")).select(
        "id", F.expr(f"cast(h >> 6 & {WORDS - 1}L as int)").alias("w"), F.expr("shiftleft(1L, cast(h & 63L as int))").alias("bit"))
    parity = [F.coalesce(F.expr(f"bit_xor(bit) FILTER (WHERE w = {w})"), F.lit(0).cast("long")).alias(f"p{w}") for w in range(WORDS)]
    return h.groupBy("id").agg(F.count("*").alias("n"), *parity)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, th, pos, line) of the lines that can be compared; ``th`` tells rows of one id apart."""
    each = docs.select("doc", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return each.filter(F.col("line").rlike(r"\S"))


def _with_lines(make, text: str = "text") -> Column:
    """``make`` of the text's lines, which are split once, however often it uses them."""
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), make), F.lit(0))


def _differ(x: str, y: str, names: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in names), F.lit(0))


def _may_link(*names: str):
    """The size bound, and the parity bound over the words ``names``."""
    def bound(x, y):
        m, n = F.col(f"{x}n"), F.col(f"{y}n")
        need = F.ceil(PERCENT * (m + n) / (100.0 + PERCENT) - 1e-9)  # of the intersection
        return (F.least(m, n) >= need) & (_differ(x, y, list(names)) <= m + n - 2 * need)
    return bound


def surplus_lines(docs: DataFrame) -> DataFrame:
    """(doc, th, gone: numbers of the lines that go) of the rows (doc, th, text) that lose any."""
    spark = docs.sparkSession
    key = (F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(1), "line").alias("l2"))
    lines = _lines(docs).select("doc", "th", "pos", *key)
    first = lines.groupBy("l1", "l2").agg(F.min(F.struct("doc", "pos", "th")).alias("at"), F.count("*").alias("weight"))
    path = scratch_path(spark, "distinct-lines")  # written: its row numbers must not change
    first.join(_signed(docs), ["l1", "l2"]).withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    distinct = spark.read.parquet(path)

    buckets = distinct.select(F.explode("bands").alias("bucket"), "id")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    paths = [scratch_path(spark, name) for name in ("shared-bands", "lines-to-verify", "line-parities")]
    buckets.join(shared, "bucket").write.parquet(paths[0])
    buckets = spark.read.parquet(paths[0])
    wanted = (distinct.join(buckets.select("id").distinct(), "id").select("at.doc", "at.th", F.struct("at.pos", "id").alias("w"))
              .groupBy("doc", "th").agg(F.collect_list("w").alias("ws")))
    found = _with_lines(lambda ls: F.transform("ws", lambda w: F.struct(w["id"].alias("id"), F.get(ls, w["pos"]).alias("line"))))
    docs.join(wanted, ["doc", "th"]).select(F.explode(found).alias("w")).select("w.id", "w.line").dropDuplicates(["id"]).write.parquet(paths[1])
    texts = spark.read.parquet(paths[1])  # text: a set takes eight times its bytes
    _parities(texts).write.parquet(paths[2])
    parities = spark.read.parquet(paths[2])
    half = [f"p{w}" for w in range(WORDS // 2)], [f"p{w}" for w in range(WORDS // 2, WORDS)]
    folds = parities.select("id", "n", *[F.expr(" ^ ".join(names)).alias(f"f{k}") for k, names in enumerate(half)])
    entries = buckets.join(folds.join(distinct.select("id", "weight"), "id"), "id")

    def verify(pairs):
        a = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
        b = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", _hashes("x").alias("x"), _hashes("y").alias("y"))
        common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), F.size(F.array_union("x", "y")).alias("u"))
        return common.filter(100 * F.col("c") >= PERCENT * F.col("u")).select("a", "b").distinct()

    late = distinct.select("id", "bands").join(parities.drop("n"), "id")
    comps = link_buckets(entries, verify, extras=("n", "f0", "f1"), may_link=_may_link("f0", "f1"), late=late,
                         may_link_late=_may_link(*half[0], *half[1]))
    for p in paths:
        forget(spark, p)
    # only lines with several occurrences or a component can lose any: the keeper of each
    grouped = (distinct.join(comps, "id", "left").filter((F.col("weight") > 1) | F.col("comp").isNotNull())
               .select("l1", "l2", "at", F.coalesce("comp", "id").alias("comp")))
    keeper = grouped.groupBy("comp").agg(F.min("at").alias("keep"))
    keys = grouped.join(keeper, "comp").select("l1", "l2", "keep")
    gone = lines.join(keys, ["l1", "l2"]).filter(F.struct("doc", "pos", "th") != F.col("keep"))
    return gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))


def drop_surplus_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "text", gone: str | None = None) -> DataFrame:
    """``docs`` with column ``into`` holding the text that is left; with ``gone``, a column of
    that name with the numbers of the lines that went."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names can't clash with the operator's
    own, body = (F.col(f"c{names.index(c)}") for c in (doc_id, text))
    keyed = plain.withColumn("doc", F.coalesce(own.cast("long"), F.lit(_NO_ID))).withColumn("th", F.xxhash64(body)).withColumn("text", body)
    lost = surplus_lines(keyed.select("doc", "th", "text"))

    def stay(ls):
        return F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))

    left = _with_lines(lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n"))
    made = {into: F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)}
    if gone:
        made[gone] = F.coalesce("gone", F.array().cast("array<int>"))
    out = keyed.join(lost, ["doc", "th"], "left")
    kept = [made.pop(c).alias(c) if c in made else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*kept, *[v.alias(c) for c, v in made.items()])


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that (nearly) repeat an earlier one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = drop_surplus_lines(docs, into="kept", gone="gone")
    return left.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
                       F.size("gone").cast("long").alias("n_removed"),
                       F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op7_fuzzy_lines": op7_fuzzy_lines}
ORACLES: dict[str, str] = {}
