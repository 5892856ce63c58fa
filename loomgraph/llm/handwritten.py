"""Source files that nobody on the team wrote by hand.

One look across files, and two at each file that is left:

* an inverted index of line hashes, least frequent first: a file whose rare lines are contained in a file of another
  repository is a copy, edited or not, wherever it lies;
* the leading comment: a program's mark that the file is its output, or another project's notice;
* the composition: minified text, data in the shape of code, members repeated by count.

Paths and ignore lists are no evidence of their own.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Scratch

#: A line is rare if at most this share of all different files (sets of lines), or this many, have it.
RARE_SHARE, RARE_MIN = 0.005, 20
#: Two holders of a more frequent line are versions of one file if they share so many lines and this part of the larger's.
ALIKE_MIN, ALIKE = 12, 0.6
#: Shorter lines (trimmed) say nothing about a file.
LINE_MIN = 12
#: A copy shares at least so many specific lines, and this part of its own, with one other file.
SHARED_MIN, CONTAINED = 5, 0.6

# --- marks in the leading comment ------------------------------------------------------------------

_LEAD = re.compile(r"(?:\s*(?:#![^\n]*|//[^\n]*|/\*.*?\*/|﻿))*", re.S)
#: Statements about the file itself: a mark at the start of a line or sentence, or a verb whose subject is
#: the file, and a request that has no other object than it.
_MADE = re.compile(
    r"\bcode generated\b|(?<!\w)@generated\b|<auto-?generated\b"
    r"|(?:^|[.;:!]\s+|\b(?:is|was|are|were|been|be|file|code|this)\s+)[\W_]*(?:auto(?:matically)?|machine)[- ]?(?:generated|made|written)\b(?!\s+(?:\w+\s+)?(?:files|clients|sources|types|ids?|names?|tests|docs)\b)"
    r"|(?:^|[.;:!]\s+|\b(?:is|was|are|were|been|file|code|this)\s+)[\W_]*(?:generated|produced|emitted|created|written|made) by (?:the |a |an )?[\w.@/-]*(?:\s[\w-]+)?\s*(?:compiler|generator|tool|script|v?\d)"
    r"|\bdo not (?:edit|modify|change)\b(?=\s*(?:$|[^\w\s]|(?:this|it|the (?:file|code|contents?|output)|by hand|manually|directly|anything|below|here)\b))"
    r"|\b(?:manual|hand|local) (?:changes|edits) (?:will be|are|get) (?:lost|overwritten)|\binstead of (?:changing|editing) (?:it|this)|자동 ?(?:으로 )?생성|직접 수정하지|automatisch (?:erzeugt|generiert)|générée? automatiquement|generado automáticamente",
    re.I | re.M,
)
_NOT_MADE = re.compile(r"\b(?:used to be|no longer|not|never|formerly|once) (?:auto-?)?(?:generated|machine)|\bby hand since\b|\bhand-?written\b|\b(?:written|made|kept) by hand\b", re.I)
#: name of the project whose notice stands there
_OWNER = re.compile(
    r"vendored from (?:the )?(?P<a>[\w.@/-]+)|copied (?:\w+ )?(?:out of|from) (?:the )?(?P<b>[\w.@/-]+)|(?:copyright|\(c\)|©)[^\n]*?\b\d{4}(?:\s*-\s*\d{4})?,? (?:by )?(?:the )?(?P<c>[\w.-]+) (?:authors|contributors|project|developers|team)|/\*!\s*\*?\s*(?P<d>[\w.@/-]+) v?\d+\.\d",
    re.I,
)

# --- composition -----------------------------------------------------------------------------------

_COMMENT_OR_TEXT = re.compile(r"//[^\n]*|/\*.*?\*/|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)", re.S)
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[\w$]+|\S", re.S)
_NUMBERED = re.compile(r"\b[^\W\d]\w*?(\d{1,6})\b")
_RUN = re.compile(r"[0-9A-Za-z+/=_-]{200,}")
_SHAPE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\d[\w.]*|[^\W\d][\w$]*|[$][\w$]*")


def _shape(m: re.Match) -> str:
    c = m.group()[0]
    return "s" if c in "\"'" else "0" if c.isdigit() else "w"


def _counted(code: str) -> int:
    """Longest run of consecutive numbers at the ends of names: members that a program counted."""
    nums = {int(x) for x in _NUMBERED.findall(code)}
    best = 0
    for n in nums:
        if n - 1 not in nums:
            k = n
            while k in nums:
                k += 1
            best = max(best, k - n)
    return best


def composition(content: str) -> str | None:
    """'data', 'minified', 'generated' or None, by the tokens alone."""
    code = _COMMENT_OR_TEXT.sub(lambda m: m.group(1) or " ", content.replace("\r", ""))
    lines = [x for x in code.split("\n") if x.strip()]
    if not lines:
        return None
    chars = sum(map(len, lines))
    bare = len("".join(code.split())) or 1
    run = max((len(m.group()) for m in _RUN.finditer(code)), default=0)
    if run >= 0.5 * bare:
        return "data"
    toks = _TOKEN.findall(code)
    values = [x for x in toks if x[0] in "\"'`" or x[0].isdigit()]
    # a few long texts are prose, many values between commas a table
    n_values = len(values) + toks.count(",")
    if len(values) >= 20 and n_values >= 0.5 * len(toks) and sum(map(len, values)) >= 0.5 * bare:
        return "data"
    if chars >= 300 and chars / len(lines) >= 80 and bare >= 0.92 * chars:
        return "minified"
    if len(lines) >= 16:
        shapes = [_SHAPE.sub(_shape, x.strip()) for x in lines]
        triples = list(zip(shapes, shapes[1:], shapes[2:], strict=False))
        if len(set(triples)) <= 0.25 * len(triples) and len(triples) >= 14 and _counted(code) >= 3:
            return "generated"
    return None


def mark(repo: str | None, content: str) -> str | None:
    """'generated', 'third-party' or None, by the comment before any code."""
    lead = _LEAD.match(content).group()
    if not lead.strip():
        return None
    if _MADE.search(lead) and not _NOT_MADE.search(lead):
        return "generated"
    for m in _OWNER.finditer(lead):
        name = next(x for x in m.groups() if x).strip(".,").lower()
        if name not in ((repo or "").lower(), "this", "our", "core", "project"):
            return "third-party"
    return None


def judge(repo: str | None, content: str | None) -> str | None:
    """Why a file by itself is no hand-written source of the team; None if nothing says so.  A null
    or blank content says nothing."""
    if not content or not content.strip():
        return None
    return mark(repo, content) or composition(content)


def judged(files: DataFrame) -> DataFrame:
    """file_id, reason of the files that their own content gives away."""

    def run(batches):
        for b in batches:
            ids, why = [], []
            for i, r, c in zip(*(b.column(x).to_pylist() for x in range(3)), strict=True):
                if w := judge(r, c):
                    ids.append(i)
                    why.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(why, pa.string())], names=["file_id", "reason"])

    kind = dict(files.dtypes)["file_id"]
    return files.select("file_id", "repo", "content").mapInArrow(run, f"file_id {kind}, reason string")


# --- copies across repositories --------------------------------------------------------------------


def copies(files: DataFrame, rare_share: float = RARE_SHARE, rare_min: int = RARE_MIN, shared_min: int = SHARED_MIN, contained: float = CONTAINED) -> DataFrame:
    """file_id of the files whose specific lines are, for ``contained`` of them, in one file of another
    repository; a file with fewer than ``shared_min`` such lines is no copy unless it is one as it stands.

    Files with equal sets of lines form one class, so copies as they stand never make pairs.  A line is
    specific if it is rare, or if its holders are versions of one file: of two random pairs of them both
    share ``ALIKE`` of their lines.  So a library's lines count however many repositories hold edited
    copies of it, while phrases of the language and preambles, whose holders differ, don't.

    A class whose n lines are contained in a partner for ``need`` of them has so many lines that occur in
    other repositories at all; most classes end there, without a pair.  It also shares with the partner at
    least one of any n - need + 1 lines, so the partners of its so many least frequent lines are all that
    can contain it.  Each line's hubs (the classes first and last by hash) are tried first: members of a
    popular group meet there.  What they don't confirm is compared exactly with every such partner of
    other repositories.
    """
    scratch = Scratch(files.sparkSession, "copies")
    line = F.filter(F.transform(F.split("content", "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "[\t﻿]", " "))), lambda x: F.length(x) >= LINE_MIN)
    hashed = files.where("file_id is not null and content is not null").select("file_id", "repo", F.array_sort(F.array_distinct(F.transform(line, lambda x: F.xxhash64(x)))).alias("hs"))
    # a file that comes again counts once
    one = hashed.where(F.size("hs") > 0).groupBy("file_id").agg(F.min(F.struct("repo", "hs")).alias("x")).select("file_id", "x.repo", "x.hs")
    one = scratch.save(one.withColumn("cls", F.xxhash64("hs", F.size("hs"))))
    cls = scratch.save(one.groupBy("cls").agg(F.min("repo").alias("r0"), F.max("repo").alias("r1"), F.min("hs").alias("hs")))
    limit = max(rare_min, int(rare_share * cls.count()))
    lines = scratch.save(cls.select("cls", "r0", "r1", F.size("hs").alias("size"), F.explode("hs").alias("h")))
    first, second = (F.struct(F.xxhash64("cls", F.lit(x)).alias("order"), "cls", "r0", "r1") for x in ("one", "two"))
    counts = scratch.save(lines.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("r0").alias("m0"), F.max("r1").alias("m1"), F.min(first).alias("a"), F.max(first).alias("z"), F.min(second).alias("b"), F.max(second).alias("y")))
    often = counts.where(F.col("df") > limit).select("h", F.explode(F.array(F.struct(F.col("a.cls").alias("p"), F.col("z.cls").alias("q")), F.struct(F.col("b.cls").alias("p"), F.col("y.cls").alias("q")))).alias("x")).select("h", "x.p", "x.q")
    tried = often.select("p", "q").distinct().join(cls.select(F.col("cls").alias("p"), F.col("hs").alias("hp")), "p").join(cls.select(F.col("cls").alias("q"), F.col("hs").alias("hq")), "q")
    both = F.size(F.array_intersect("hp", "hq"))
    alike = tried.select("p", "q", ((both >= ALIKE_MIN) & (both >= ALIKE * F.greatest(F.size("hp"), F.size("hq")))).alias("alike"))
    popular = scratch.save(often.join(alike, ["p", "q"]).groupBy("h").agg(F.min("alike").alias("alike")).where("alike").select("h", F.lit(True).alias("popular")))
    counts = counts.join(popular, "h", "left").where((F.col("df") <= limit) | F.col("popular"))
    # classes of several repositories are copies as they stand
    single = lines.where("r0 <=> r1")
    # as many entries as the file has lines; those of this repository alone come first
    entry = F.struct(((F.col("m0") != F.col("r0")) | (F.col("m1") != F.col("r0"))).alias("away"), "df", "h")
    known = single.join(counts.select("h", "df", "m0", "m1"), "h").groupBy("cls", "r0").agg(F.array_sort(F.collect_list(entry)).alias("own")).where(F.size("own") >= shared_min)
    known = known.withColumn("need", F.greatest(F.lit(shared_min), F.ceil(F.lit(contained) * F.size("own")).cast("int")))
    known = scratch.save(known.where(F.size(F.filter("own", lambda x: x["away"])) >= F.col("need")))
    prefix = known.select("cls", "r0", "need", F.explode(F.expr("slice(own, 1, size(own) - need + 1)")).alias("x")).where("x.away")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(known.select("cls", F.col("own.h").alias("own"), "need"), "cls").join(cls.select(F.col("cls").alias("partner"), "hs"), "partner")
        return scratch.save(both.where(F.size(F.array_intersect("own", "hs")) >= F.col("need")).select("cls").distinct())

    near = prefix.select("cls", "r0", F.col("x.h").alias("h")).join(counts.select("h", F.array("a", "z", "b", "y").alias("hubs")), "h")
    hubs = scratch.save(near.select("cls", "r0", F.explode("hubs").alias("p")).where("cls <> p.cls and not (p.r0 = r0 and p.r1 = r0)").select("cls", F.col("p.cls").alias("partner")).distinct())
    quick = confirmed(hubs)
    left = prefix.join(quick, "cls", "left_anti").select("cls", "r0", "need", F.col("x.h").alias("h"))
    partners = lines.select(F.col("cls").alias("partner"), F.col("r0").alias("h0"), F.col("r1").alias("h1"), "size", "h")
    exact = left.join(partners, "h").where("cls <> partner and size >= need and not (h0 = r0 and h1 = r0)").select("cls", "partner").distinct()
    slow = confirmed(exact.join(hubs, ["cls", "partner"], "left_anti"))
    whole = cls.where(F.col("r0") != F.col("r1")).where(F.size("hs") >= shared_min).select("cls")
    return one.join(quick.union(slow).union(whole).distinct(), "cls", "left_semi").select("file_id")


def not_handwritten(files: DataFrame) -> DataFrame:
    """file_id, reason ('copy', else 'generated', 'third-party', 'minified' or 'data'), one row a file.

    The index decides first.  Marks and token composition decide for the files it leaves; they are read where
    the contents lie, and only the reasons of copies are dropped, so that no content moves.
    """
    scratch = Scratch(files.sparkSession, "handwritten")
    copied = scratch.save(copies(files).distinct())
    rest = judged(files).groupBy("file_id").agg(F.max("reason").alias("reason")).join(copied, "file_id", "left_anti")
    return copied.withColumn("reason", F.lit("copy")).unionByName(rest)
