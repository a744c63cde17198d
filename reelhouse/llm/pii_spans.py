"""Personal data spans with built-in functions only.

Regular expressions propose spans, checks confirm them (octets, Luhn, digit counts, mod-97, the make-up of a
key), and words near a span adjust its score. Base kinds stay whatever their score; of the other kinds those stay whose
score reaches ``KEEP``, so a key-like token is a secret only where a word nearby says so. Everything is one projection over the texts: no
shuffle, no Python.

How spans get positions without a UDF: ``regexp_extract_all`` gives the matches and ``split``
on the same pattern the text between them; running sums of their lengths are the offsets
(code points, as ``length`` counts). The patterns are written so that a match attempt never
runs over the same characters twice: a run of allowed characters is entered only at its first
character (or where the last match ended, ``\\G``) and is possessive, so very long digit or
letter runs stay linear and need no deep recursion. They match what the plain forms match.

Defined cases: null text counts as empty; empty text has no spans; repeated rows are judged
one by one; other columns of the input pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in their listed order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE_KINDS = KINDS[:4]

# The proposal patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
# An address part of at most 255, and words that make a kind likelier nearby.
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_OK = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
CONTEXT = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|amex|payment|credit",
    "phone": "phone|tel|telephone|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "secret": "api[ _-]?key|key|secret|token|passw(?:or)?d|credentials?|auth",
}
#: Score of a confirmed proposal by what confirms it, before context.
BASE_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "secret": 0.4}
CONTEXT_GAIN, CONTEXT_SPAN, CHUNK = 0.15, 40, 256
#: The least score of a span that is not of a base kind.
KEEP = 0.5
#: A key's length, and how many different characters it has at least.
KEY_LENGTHS, KEY_VARIETY = (20, 200), 10


def _context(kind: str) -> str:
    """The words between other characters than letters."""
    return f"(?i)(?:^|[^A-Za-z])(?:{CONTEXT[kind]})(?:[^A-Za-z]|$)"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(m)
    n = F.length(d)

    def add(acc, i):
        x = F.substring(d, n + 1 - i, F.lit(1)).cast("int")
        x2 = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(i % 2 == 0, x2).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def _mod97(m: Column) -> Column:
    """Letters as 10 to 35, the first four characters moved to the end: remainder 1."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    s = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

    def add(acc, i):
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_OK)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "secret":  # letters and digits, varied
        varied = F.size(F.array_distinct(F.split(m, ""))) >= KEY_VARIETY
        return F.when(F.length(m).between(*KEY_LENGTHS) & m.rlike("[0-9]") & m.rlike("[A-Za-z]"), varied).otherwise(False)
    return F.lit(True)


def _running_sums(steps: Column) -> Column:
    """Sums of the elements before each element, in chunks so that long lists stay cheap."""
    n = F.size(steps)
    chunk_no = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    totals = F.transform(chunk_no, lambda c: F.aggregate(
        F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)), F.lit(0).cast("long"), lambda a, x: a + x))

    def inner(c):
        base = F.aggregate(F.slice(totals, F.lit(1), c), F.lit(0).cast("long"), lambda a, x: a + x)
        part = F.slice(steps, c * CHUNK + 1, F.lit(CHUNK))
        sums = F.aggregate(part, F.array(base), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.slice(sums, F.lit(1), F.size(part))

    return F.flatten(F.transform(chunk_no, inner))


SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string,score:double>>"


def find_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` plus an array column of spans (start, kind as an index of ``KINDS``, end
    exclusive, matched text, score), sorted by start, then kind."""
    names, t, made = docs.columns, "__pii_text", []
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names can't clash with the operator's
    out = out.withColumn(t, F.coalesce(F.col(f"c{names.index(text)}"), F.lit("")))
    for kind in KINDS:
        found = F.regexp_extract_all(F.col(t), F.lit(PATTERNS[kind]), F.lit(0))
        if kind == "email":
            found = F.when(F.contains(F.col(t), F.lit("@")), found).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(f"__m_{kind}", found)
    for no, kind in enumerate(KINDS):
        m, p, s = f"__m_{kind}", f"__p_{kind}", f"__s_{kind}"
        any_ok = F.exists(F.col(m), lambda x: _confirmed(kind, x))
        # the text between matches is needed only where a match holds
        out = out.withColumn(p, F.when(any_ok, F.split(F.col(t), PATTERNS[kind], -1)))
        steps = F.zip_with(F.slice(F.col(p), F.lit(1), F.size(m)), F.col(m), lambda a, b: F.length(a) + F.length(b))
        out = out.withColumn(s, F.when(F.col(p).isNotNull(), _running_sums(steps)))

        def span(i):
            gap, value = F.element_at(F.col(p), i), F.element_at(F.col(m), i)
            start = F.element_at(F.col(s), i) + F.length(gap)
            after = F.element_at(F.col(p), i + 1)
            near = F.right(gap, F.lit(CONTEXT_SPAN)).rlike(_context(kind)) | \
                F.substr(after, F.lit(1), F.lit(CONTEXT_SPAN)).rlike(_context(kind))
            ok = _confirmed(kind, value)
            if kind == "iban":  # a whole token: no letter or digit touches it
                ok = ok & ~F.right(gap, F.lit(1)).rlike("[A-Za-z0-9]") & \
                    ~F.substr(after, F.lit(1), F.lit(1)).rlike("[A-Za-z0-9]")
            score = F.lit(BASE_SCORE[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0)
            if kind not in BASE_KINDS:
                ok = ok & (score >= KEEP)
            return F.when(ok, F.struct(start.alias("start"), F.lit(no).alias("kind"),
                                       (start + F.length(value)).alias("end"), value.alias("value"),
                                       score.alias("score")))

        each = F.transform(F.sequence(F.lit(1), F.size(m)), span)
        made.append(F.when(F.col(p).isNotNull(), F.filter(each, lambda x: x.isNotNull()))
                    .otherwise(F.array()).cast(SPAN))
    out = out.withColumn("__spans", F.array_sort(F.concat(*made)))
    kept = [(F.col("__spans") if c == into else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)]
    return out.select(*kept, *([] if into in names else [F.col("__spans").alias(into)]))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: counts by base kind, digest of the base spans, all
    spans, and the highest score in percent (0 without spans)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = find_spans(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))

    def count(no):
        return F.size(F.filter("spans", lambda s: s["kind"] == no)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return d.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                    _joined(F.col("spans")).alias("spans"),
                    F.round(100 * F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))).cast("long").alias("top_score"))


def _oracle() -> str:
    """The plain forms of the patterns in DuckDB, positions from list sums."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
        "secret": r"[A-Za-z0-9+/_-]{20,}",
    }
    luhn = ("len(dg) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(dg) + 1), lambda i: "
            "CASE WHEN i % 2 = 0 THEN (CASE WHEN dg[len(dg) + 1 - i]::INT > 4 THEN dg[len(dg) + 1 - i]::INT * 2 - 9 "
            "ELSE dg[len(dg) + 1 - i]::INT * 2 END) ELSE dg[len(dg) + 1 - i]::INT END)) % 10 = 0")
    iban = ("list_reduce(list_prepend(0, list_transform(string_split(mv, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' "
            "THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, x: "
            "CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1 "
            "AND NOT regexp_matches(right(gap, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')")
    ok = {"email": "true", "ip": f"regexp_matches(v, '{IP_OK}')", "card": luhn,
          "phone": "len(dg) BETWEEN 9 AND 15", "iban": iban,
          "secret": f"length(v) BETWEEN {KEY_LENGTHS[0]} AND {KEY_LENGTHS[1]} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') "
                    f"AND len(list_distinct(string_split(v, ''))) >= {KEY_VARIETY}"}
    parts = []
    for i, k in enumerate(KINDS):
        parts.append(f"""SELECT doc_id, {i} AS k, s, s + length(v) AS e, ({ok[k]}) AS ok,
  {round(100 * BASE_SCORE[k])} + CASE WHEN regexp_matches(right(gap, {CONTEXT_SPAN}), '{_context(k)}')
    OR regexp_matches(left(after, {CONTEXT_SPAN}), '{_context(k)}') THEN {round(100 * CONTEXT_GAIN)} ELSE 0 END AS score FROM (
  SELECT doc_id, m[i] AS v, p[i] AS gap, p[i + 1] AS after, regexp_replace(m[i], '[^0-9]', '', 'g') AS dg,
    replace(m[i], ' ', '')[5:] || left(replace(m[i], ' ', ''), 4) AS mv,
    coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{plain[k]}') AS m,
           string_split_regex(coalesce(text, ''), '{plain[k]}') AS p FROM documents)))""")
    names = "['email', 'ip', 'card', 'phone', 'iban', 'secret']"
    count = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{n}" for i, n in enumerate(BASE_KINDS))
    item = f"{names}[k + 1] || ':' || s || ':' || e"
    return f"""WITH found AS ({' UNION ALL '.join(parts)}), good AS (SELECT * FROM found WHERE ok AND (k < 4 OR score >= {round(100 * KEEP)}))
SELECT d.doc_id, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n in BASE_KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(top_score, 0) AS top_score
FROM documents d LEFT JOIN (
  SELECT doc_id, {count}, string_agg({item}, ',' ORDER BY s, k) FILTER (WHERE k < 4) AS base,
         string_agg({item}, ',' ORDER BY s, k) AS spans, max(score) AS top_score FROM good GROUP BY doc_id) g ON d.doc_id = g.doc_id"""


QUERIES = {"op6_pii_spans": op6_pii_spans}
ORACLES = {"op6_pii_spans": _oracle()}
