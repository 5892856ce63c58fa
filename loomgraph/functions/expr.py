"""Column expressions shared by the operators; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and what they fold to, as full-text search compares them.
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def make_id(qname: str | Column, language: str | Column, start_byte: str | Column) -> Column:
    """Node id: 16 hex digits of the hash of name, language and offset; the path doesn't enter."""
    return F.substring(F.sha2(F.concat_ws("|", c(qname), c(language), c(start_byte).cast("string")), 256), 1, 16)


def estimate_tokens(s: str | Column) -> Column:
    return F.floor((F.octet_length(F.coalesce(c(s), F.lit(""))) + 3) / 4).cast("bigint")


def simple_name(q: str | Column) -> Column:
    return F.substring_index(c(q), ".", -1)


def package_part(q: str | Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.regexp_extract(c(q), r"^(.+)\.[^.]*$", 1)


def before_hash(q: str | Column) -> Column:
    return F.substring_index(c(q), "#", 1)


def dirname(p: str | Column) -> Column:
    """The folder of a path; a file at the top is its own folder."""
    p = c(p)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(p)


def basename(p: str | Column) -> Column:
    return F.substring_index(c(p), "/", -1)


def extension(p: str | Column) -> Column:
    return F.lower(F.regexp_extract(c(p), r"(\.[^./]*)$", 1))


def language_of(p: str | Column) -> Column:
    e = extension(p)
    return F.when(e == ".go", "go").when(e.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "ts").when(e == ".sol", "sol")


def visibility(name: str | Column) -> Column:
    return F.when(F.substring(c(name), 1, 1).between("A", "Z"), "exported").otherwise("private")


def depth_of(q: str | Column) -> Column:
    return (F.length(c(q)) - F.length(F.replace(c(q), F.lit("/"), F.lit("")))).cast("int")


def mesh_scale(usage: str | Column) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(3.5), F.lit(0.5) + F.lit(0.6) * F.log10(c(usage) + F.lit(1.0))))


def radius_2d(usage: str | Column) -> Column:
    return F.greatest(F.lit(2.0), F.lit(3.0) + F.lit(1.5) * F.log10(c(usage) + F.lit(1.0)))


# Drawing alpha by confidence, opacity by distance from the focus.
ALPHA = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.4}
FOCUS_OPACITY = [1.0, 0.92, 0.55, 0.18]


def alpha(confidence: str | Column) -> Column:
    e = F.lit(1.0)
    for k, v in ALPHA.items():
        e = F.when(c(confidence) == k, v).otherwise(e)
    return e


def focus_opacity(distance: str | Column) -> Column:
    """Opacity by hop distance; what the focus doesn't reach is as far as the last step."""
    d = F.least(F.coalesce(c(distance), F.lit(3)), F.lit(3)) + 1
    return F.element_at(F.array(*[F.lit(x) for x in FOCUS_OPACITY]), d.cast("int"))


def fold(s: str | Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(F.coalesce(c(s), F.lit(""))), _MARKED, _PLAIN)


def tokens(s: str | Column) -> Column:
    """Words of letters and digits, folded."""
    return F.regexp_extract_all(fold(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def common_prefix(names: Column) -> Column:
    """Longest common prefix of an array of strings."""
    first = F.element_at(names, 1)
    return F.aggregate(names, first, lambda acc, x: F.substring(acc, F.lit(1), F.aggregate(F.sequence(F.lit(1), F.length(acc) + 1), F.lit(0), lambda n, i: F.when((i == n + 1) & (i <= F.length(acc)) & (F.substring(acc, F.lit(1), i) == F.substring(x, F.lit(1), i)), i).otherwise(n))))


def like_escape(s: str) -> str:
    """A literal for LIKE patterns with backslash as escape."""
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


# --- evaluation texts ---------------------------------------------------------------------------


def extract_symbols(text: str | Column) -> Column:
    """Dotted words of an answer, outer punctuation off, in order, repeats kept."""
    words = F.split(F.coalesce(c(text), F.lit("")), r'[ ,\n"`]+')
    dotted = F.filter(words, lambda w: F.contains(w, F.lit(".")) & ~F.startswith(w, F.lit(".")) & ~F.endswith(w, F.lit(".")))
    return F.transform(dotted, lambda w: F.btrim(w, F.lit(".:;()")))


def precision(got: Column, want: Column) -> Column:
    g = F.array_distinct(got)
    return F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(g, want)) / F.size(g))


def recall(got: Column, want: Column) -> Column:
    w = F.array_distinct(want)
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_intersect(w, got)) / F.size(w))


def rubric_hit(output: Column, rubric: Column, share: float = 0.6) -> Column:
    """Do enough of a rubric's words (4 bytes or more) occur in the output, without case?"""
    out = F.lower(F.coalesce(output, F.lit("")))
    words = F.filter(F.split(F.lower(F.trim(rubric)), r"\s+"), lambda w: F.octet_length(w) >= 4)
    hits = F.size(F.filter(words, lambda w: F.contains(out, w)))
    return (F.size(words) > 0) & (hits >= share * F.size(words))
