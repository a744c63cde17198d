"""Column expressions used by the operators. All are built-in Spark functions (JVM side,
inside whole-stage codegen where Spark supports it); none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# A signed base-10 int64 literal as strconv.ParseInt accepts it: optional sign, digits only.
INT_LITERAL = r"^[+-]?[0-9]+$"
# A decimal float literal (ParseFloat minus the inf / nan / hex / underscore spellings).
FLOAT_LITERAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_int64(c: str | Column) -> Column:
    """Strict int64 parse: NULL unless the whole text is a signed integer that fits.
    The regex runs first because ``try_cast(' 12' AS BIGINT)`` would accept padding."""
    c = col(c)
    return F.when(c.rlike(INT_LITERAL), c.try_cast("bigint"))


def parse_float64(c: str | Column) -> Column:
    """Strict float parse: NULL unless the whole text is a decimal literal within range."""
    c = col(c)
    v = c.try_cast("double")
    return F.when(c.rlike(FLOAT_LITERAL) & (F.abs(v) < float("inf")), v)


def seconds_to_ns(c: str | Column) -> Column:
    """float seconds -> int64 nanoseconds, truncating toward zero (Duration conversion); NULL
    where they don't fit."""
    return (col(c) * F.lit(1e9)).try_cast("bigint")


def ns_to_seconds(c: str | Column) -> Column:
    return col(c).cast("double") / F.lit(1e9)


def int_div(a: str | Column, b: str | Column) -> Column:
    """Integer division truncating toward zero (SQL `div`); NULL when b = 0."""
    a, b = col(a).cast("bigint"), col(b).cast("bigint")
    return F.when(b != 0, F.call_function("div", a, b))


def percentage(current: str | Column, total: str | Column) -> Column:
    """min(current*100 / total, 100) with integer division truncating toward zero and no
    lower bound. Overflow of current*100 yields NULL (try_multiply) instead of wrapping."""
    prod = F.try_multiply(col(current).cast("bigint"), F.lit(100).cast("bigint"))
    q = int_div(prod, total)
    return F.when(q.isNotNull(), F.least(q, F.lit(100).cast("bigint")))  # least() would skip a NULL


def whole_json(c: str | Column) -> Column:
    """Whether the text is one JSON value and nothing else (false for NULL). The JSON functions
    stop at the end of the first value; inside an array any trailing text shows. A value that
    closes that array itself cannot also be the member of an object."""
    c = col(c)
    one = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    member = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), c, F.lit("}")))) == 1
    return F.coalesce(one & F.when(c.contains("]"), member).otherwise(F.lit(True)), F.lit(False))


def json_text_or_absent(doc: Column, path: str) -> Column:
    """Whether the value at ``path`` is a string, null or missing."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant"))
    return F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))


def format_text(template: str | Column, args: str | Column) -> Column:
    """``template`` with its verbs replaced by ``args`` (array of text) in order, as one fold over the
    template's parts: %s and %v take any argument, %d an integer, %% is a percent sign.

    What doesn't fit is marked, as a service's log would show it: an absent argument ``%!s(MISSING)``, one
    of the wrong kind or under another verb ``%!d(string=x)``, a null one ``%!s(<nil>)`` (%v: ``<nil>``), a
    percent sign at the end ``%!(NOVERB)``, and arguments that are left ``%!(EXTRA string=x, string=y)``.
    Flags and widths are not known. A null template gives null, null args are none."""
    t, a = col(template), F.coalesce(col(args), F.array().cast("array<string>"))
    parts = F.regexp_extract_all(t, F.lit("(?s)%.|%$|[^%]+"), F.lit(0))

    def step(acc: Column, part: Column) -> Column:
        verb, arg = F.substring(part, 2, 1), F.get(a, acc["n"])
        takes = part.startswith("%") & ~part.isin("%", "%%")
        text = (F.when(~part.startswith("%"), part).when(part == "%%", "%").when(part == "%", "%!(NOVERB)")
                .when(acc["n"] >= F.size(a), F.concat(F.lit("%!"), verb, F.lit("(MISSING)")))
                .when(arg.isNull(), F.when(verb == "v", "<nil>").otherwise(F.concat(F.lit("%!"), verb, F.lit("(<nil>)"))))
                .when(verb.isin("s", "v") | ((verb == "d") & arg.rlike(r"^-?[0-9]+$")), arg)
                .otherwise(F.concat(F.lit("%!"), verb, F.lit("(string="), arg, F.lit(")"))))
        return F.struct(F.concat(acc["out"], text).alias("out"), (acc["n"] + takes.cast("int")).alias("n"))

    def finish(acc: Column) -> Column:
        rest = F.transform(F.slice(a, acc["n"] + 1, F.size(a)), lambda x: F.coalesce(F.concat(F.lit("string="), x), F.lit("<nil>")))
        return F.when(acc["n"] < F.size(a), F.concat(acc["out"], F.lit("%!(EXTRA "), F.array_join(rest, ", "), F.lit(")"))).otherwise(acc["out"])

    return F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, finish)


def basename(path: str | Column) -> Column:
    """Last element of a '/'-separated path (the manifest name a worker reports)."""
    return F.element_at(F.split(col(path), "/"), -1)


def relative_to(path: str | Column, base: str) -> Column:
    """``path`` relative to ``base`` (NULL when it is not below base)."""
    b = base.rstrip("/") + "/"
    p = col(path)
    return F.when(p.startswith(b), p.substr(F.lit(len(b) + 1), F.length(p)))


def channel_of(job_id: str | Column) -> Column:
    """Progress channel of a job: video:<job_id>:progress."""
    return F.concat(F.lit("video:"), col(job_id), F.lit(":progress"))


def job_of_channel(channel: str | Column) -> Column:
    return F.regexp_extract(col(channel), r"^video:(.*):progress$", 1)


def has_permission(perms: str | Column, slug: str | Column) -> Column:
    """membership in the permission list; a NULL list is false."""
    s = F.lit(slug) if isinstance(slug, str) else slug
    return F.coalesce(F.array_contains(col(perms), s), F.lit(False))


def video_status_flags(status: str | Column = "status") -> dict[str, Column]:
    st = col(status)
    return {
        "is_pending": st == S.VIDEO_PENDING, "is_processing": st == S.VIDEO_PROCESSING,
        "is_published": st == S.VIDEO_PUBLISHED, "is_failed": st == S.VIDEO_FAILED,
        "is_archived": st == S.VIDEO_ARCHIVED,
        "can_be_processed": st.isin(S.VIDEO_PENDING, S.VIDEO_FAILED),
    }


def job_status_flags(status: str | Column = "status") -> dict[str, Column]:
    st = col(status)
    return {
        "is_pending": st == S.JOB_PENDING, "is_running": st == S.JOB_RUNNING,
        "is_completed": st == S.JOB_COMPLETED, "is_failed": st == S.JOB_FAILED,
        "can_be_started": st.isin(S.JOB_PENDING, S.JOB_FAILED),
    }


def first_error(*rules: tuple[Column, str]) -> Column:
    """Ordered validation: the text of the first failing rule, NULL if all pass."""
    out = None
    for failed, msg in rules:
        out = F.when(failed, F.lit(msg)) if out is None else out.when(failed, F.lit(msg))
    return out


def blank(c: str | Column) -> Column:
    c = col(c)
    return c.isNull() | (c == "")


def clean_path(p: str | Column) -> Column:
    """Lexical path clean of an absolute or relative '/'-separated path: drop empty and '.'
    parts, let '..' pop the previous part (never above the root of an absolute path)."""
    p = col(p)
    parts = F.split(p, "/")
    absolute = p.startswith("/")
    empty = F.array().cast("array<string>")

    def step(acc, part):
        popped = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        keep_dotdot = (F.size(acc) == 0) | (F.element_at(acc, -1) == "..")
        return (F.when((part == "") | (part == "."), acc)
                 .when(part == "..", F.when(keep_dotdot,
                                            F.when(absolute, acc).otherwise(F.concat(acc, F.array(part))))
                                     .otherwise(popped))
                 .otherwise(F.concat(acc, F.array(part))))

    folded = F.aggregate(parts, empty, step)
    joined = F.array_join(folded, "/")
    return (F.when(absolute, F.concat(F.lit("/"), joined))
             .otherwise(F.when(joined == "", F.lit(".")).otherwise(joined)))
