"""Problem 1: source files that nobody wrote by hand.

Attribute files (``.gitattributes``) declare generated and vendored paths: the
rule of the deepest directory wins, and in one file the last. Repositories
without such a file get equivalent patterns: the public conventions of
``DEFAULT_RULES``, which is an attribute file itself and goes through the same
parser, and patterns mined from files whose text proves what they are: a
directory, or a prefix or suffix of file names, of which at least ``PURITY`` are
not written by hand, with ``SUPPORT`` proven files in ``REPOS`` repositories. Texts
prove only a part of such files; how large that part is shows on the files that
the default rules mark. The proof, which also
decides about files that no pattern covers, is the text: comments that say a
tool made the file or where it was copied from, minified layout, or literals
that fill half of it, however their lines are laid out.

Defined results: a null or blank text is evidence of nothing, so only the
path counts; a null path only lets the text count; a null repository is one
without attribute files; repeated rows are judged alike; an empty table gives
no rows; other columns are dropped. A declaration that a path is *not*
generated or vendored overrules patterns and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, stored, table
from .languages import DATA, language_of
from .p3_splits import filled, repo_name
from .skew import look_up

PURITY, SUPPORT, REPOS = 0.5, 4, 3
ROW, BLOB = 12, 400  # least literals of a table without lines of its own, least characters of an encoded literal

#: Public conventions for generated, vendored, minified and lock files, as an attribute file.
DEFAULT_RULES = "\n".join(
    [
        *(f"**/{d}/** linguist-vendored" for d in "vendor node_modules bower_components jspm_packages third_party thirdparty third-party 3rdparty external_libs godeps pods carthage .yarn site-packages".split()),
        *(f"**/{d}/** linguist-generated" for d in "generated generated-sources generated-src gen autogen codegen __generated__".split()),
        *(
            f"{name} linguist-generated"
            for name in (
                "*_pb2.py *_pb2_grpc.py *_pb2.pyi *_pb2_grpc.pyi *.pb.go *.pb.cc *.pb.h *.pb.gw.go *[._]pb.js *[._]pb.ts *[._]pb.rs *[._]pb.swift *_pb.d.ts *.g.ts *.g.dart *.g.cs *.g.js "
                "*[._]generated.* *_gen.go zz_generated.*.go *.designer.cs *.tab.[ch] *.yy.c *[.-]min.* *.bundle.* moc_*.cpp ui_*.h qrc_*.cpp "
                "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml go.sum cargo.lock poetry.lock composer.lock gemfile.lock pipfile.lock"
            ).split()
        ),
    ]
)
_HINT = re.compile(r"(?i)generated|do not (?:edit|modify)|manual edits|changes will be lost|vendored|copied|bundled copy|third[- ]party|imported snapshot|part of the|sourceMappingURL")
_MADE = re.compile(
    r"(?i)auto-?\s?generated|automatically generated|(?:machine|code|file|tool)[- ]generated|\bgenerated (?:by|from|on|with|using|at)\b|@generated\b|<auto-?generated|\bdo not (?:edit|modify)\b|\bdon't edit\b|\bmanual (?:edits|changes)\b.*\b(?:overwritten|lost)|\bchanges will be (?:lost|overwritten)|\bregenerate (?:it )?(?:with|using|by)\b"
)
_TAKEN = re.compile(
    r"(?i)\bvendored (?:from|copy of|version of)|\bcopied (?:\w+ )?from\b|\bbundled copy of|\bthird[- ]party code\b|\bpart of the [\w-]+ (?:library|project|framework|package)\b|\bimported snapshot\b|\bimported from upstream\b|\bsend (?:fixes|patches) upstream\b"
)
_DENIED = re.compile(r"(?i)\b(?:not|never|isn't|no longer|without) (?:auto-?|automatically |machine[- ])?generated|\bnot (?:vendored|copied)|\b(?:(?:maintained|written|made|edited) by hand|hand[- ]?(?:written|made|edited)|edit freely)\b")
_COMMENT = re.compile(r"^\s*(?://|#(?!\s*(?:define|include|if|else|pragma|error|warning)\b)|--|/\*|\*|<!--|;|\"\"\"|'''|\"[$_]?(?:notice|comment|generated(?:[_-]?by)?|warning|header|//)\"\s*:)")
_CLOSED = re.compile(r"^(\s*(?:/\*.*?\*/|<!--.*?-->)).*")
_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`")
_LOCK = re.compile(r'"(?:lockfileVersion|integrity)"\s*:\s*(?:\d|"sha\d+-)')
_LITERAL = r"""(?:[-+]?(?:0[xX][0-9a-fA-F_]++|\d[\d._]*+(?:[eE][-+]?\d++)?+)(?:[iuf]\d++|[uUlLfF]*+(?:[iuf]\d++)?+)|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"""
#: A line of literals alone. Nothing is given back (possessive), so lines of any length take linear time.
_LITERALS = re.compile(rf"\s*+[\[{{(]*+\s*+(?:{_LITERAL}\s*+[\])}}]*+\s*+(?:[,;]|$)\s*+[\[{{(]*+\s*+)++[\])}},;]*+\s*+$")
#: A run of at least ``ROW`` literals wherever it stands; the other alternatives pass over strings, numbers and words whole.
_RUN = re.compile(
    rf"""(?P<run>(?:{_LITERAL}(?=[\s,;\])}}]|\Z)[\s,;\[\](){{}}]*+){{{ROW},}}+)|"(?:[^"\\\n]|\\.)*+"?+|'(?:[^'\\\n]|\\.)*+'?+|`[^`\n]*+`?+|(?:[^\W\d]\w*+|[^\w"'`+-])++|\d\w*+|[\s\S]"""
)
#: The inside of one literal in base64, hex or escaped bytes, also over several lines, with or without a data URI before it.
_BYTES = r"(?:[A-Za-z0-9+/_=-]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{1,3})"
_ENCODED = re.compile(rf"""(["'`])(?:\1\1)?+\s*+(?:data:[\w/+.;=-]++,)?+((?:{_BYTES}{{32,}}+(?:\\?\r?\n[ \t]*+)?+)++{_BYTES}*+)\s*+\1""")


def literal_data(text: str, lines: list[str]) -> bool:
    """Whether at least half of the text are literals: lines of nothing else, runs of them, or single encoded ones."""
    half = 0.5 * len(text)
    if len(lines) >= 12 and sum(len(x) for x in lines if _LITERALS.match(x)) >= half:
        return True
    if sum(len(m[0]) for m in _ENCODED.finditer(text) if len(m[2]) >= BLOB and len(set(m[2])) >= 8) >= half:
        return True
    return sum(len(m[0]) for m in _RUN.finditer(text) if m["run"]) >= half


def text_evidence(text: str | None, language: str | None) -> str | None:
    """``generated``, ``vendored``, ``minified``, ``data`` or None."""
    if not text or not text.strip():
        return None
    lines = text.split("\n")
    hinted = bool(_HINT.search(text))
    mapped = False
    if hinted:
        for line in lines:
            if _HINT.search(line) and _COMMENT.match(line):
                line = _CLOSED.sub(r"\1", line)  # code behind a comment is no notice
                if _DENIED.search(line):
                    continue
                if _MADE.search(line):
                    return "generated"
                if _TAKEN.search(line):
                    return "vendored"
                mapped |= "sourceMappingURL=" in line
    if language in (None, "json") and len(_LOCK.findall(text)) >= 3:
        return "generated"
    long = sum(len(x) for x in lines if len(x) > 300)
    if language not in DATA and (long >= 0.6 * len(text) or mapped and long >= 0.2 * len(text)):
        code = [_QUOTED.sub("", x) for x in lines if len(x) > 300]  # one long literal is no minified code
        dense = sum(map(len, code))
        if dense >= 0.3 * len(text) and sum(x.count(" ") for x in code) < 0.12 * dense:
            return "minified"
    return "data" if language not in DATA and literal_data(text, lines) else None


def path_features(path: str | None) -> list[str]:
    """Directory names, and the prefix and suffixes of the file name, as pattern keys."""
    if not path or not path.strip():
        return []
    *folders, name = [x for x in path.strip().lower().split("/") if x] or [""]
    out = {f"dir:{x}" for x in folders}
    if m := re.search(r"[._-][a-z0-9]+\.[a-z0-9]+$", name):
        out.add(f"end:{m.group()}")
    if m := re.match(r"[a-z0-9]+[_-]", name):
        out.add(f"start:{m.group()}")
    return sorted(out)


def glob_regex(pattern: str) -> str:
    """A path pattern of an attribute file as a regex over paths relative to the file's directory."""
    body = pattern.strip().strip('"')
    anywhere = "/" not in body.rstrip("/")
    body = body.lstrip("/")
    folder = body.endswith("/")
    body = body.rstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + (re.escape(c) if not c.isalnum() else c), i + 1
    return ("^(?:.*/)?" if anywhere else "^") + out + ("/.*$" if folder else "$")


def parse_attributes(text: str | None) -> list[tuple[int, str, bool]]:
    """(line, regex, marked) of each rule on generated or vendored paths; ``-attr`` and ``=false`` unmark."""
    out = []
    for n, line in enumerate((text or "").split("\n")):
        words = line.strip().split()
        if len(words) < 2 or words[0].startswith("#"):
            continue
        for word in words[1:]:
            m = re.fullmatch(r"([-!]?)linguist-(?:generated|vendored)(?:=(\w+))?", word)
            if m:
                out.append((n, glob_regex(words[0]), not m.group(1) and (m.group(2) or "true").lower() not in ("false", "0", "no")))
    return out


_DEFAULTS = [(re.compile(r), marked) for _, r, marked in parse_attributes(DEFAULT_RULES)]


def by_convention(path: str | None) -> bool:
    """Whether the last of the default rules that covers a path marks it."""
    relative = (path or "").strip().lower().lstrip("/")
    return bool(relative) and next((marked for rule, marked in reversed(_DEFAULTS) if rule.match(relative)), False)


def evidence(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """``id``, ``repo``, ``path``, ``says`` (evidence of the text), ``convention``, ``features`` and ``rules`` (of an attribute file, else null) of each row; one scan."""
    rule = pa.struct([("line", pa.int32()), ("regex", pa.string()), ("marked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, repos, paths, languages, texts = (c.to_pylist() for c in batch.columns)
            says = [text_evidence(t, language_of(g)) for t, g in zip(texts, languages)]
            rules = [[dict(zip(("line", "regex", "marked"), r)) for r in parse_attributes(t)] if p and p.strip().rsplit("/", 1)[-1] == ".gitattributes" else None for p, t in zip(paths, texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(repos, pa.string()), pa.array(paths, pa.string()), pa.array(says, pa.string()), pa.array(list(map(by_convention, paths)), pa.bool_()), pa.array(list(map(path_features, paths)), pa.list_(pa.string())), pa.array(rules, pa.list_(rule))],
                ["id", "repo", "path", "says", "convention", "features", "rules"],
            )

    picked = df.select(F.col(key).cast("long").alias("id"), repo_name(F.col("repo")).alias("repo"), filled(F.col("path")).alias("path"), "language", "original_code")
    return picked.mapInArrow(run, "id long, repo string, path string, says string, convention boolean, features array<string>, rules array<struct<line:int,regex:string,marked:boolean>>")


def declared(rows: DataFrame) -> DataFrame:
    """``id``, ``declares`` (the repository has an attribute file) and ``marked`` (by the rule that covers the path, else null) of :func:`evidence`.

    The rules of a directory are one row of an array, so a hot repository multiplies no rows.
    """
    path = F.regexp_replace(F.trim("path"), r"^/+", "")
    spot = F.concat_ws("\0", "repo", "folder")
    ruled = rows.where(F.size("rules") > 0).select("repo", F.regexp_replace(path, r"[^/]*$", "").alias("folder"), F.explode("rules").alias("rule"))
    per = stored(ruled.where(F.col("repo").isNotNull()).groupBy("repo", "folder").agg(F.collect_set("rule").alias("rules")).select("repo", spot.alias("spot"), "rules"), "rules")
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, F.greatest(k, F.lit(1))), "/"), F.lit("/"))))
    known = look_up(rows.select("id", "repo", path.alias("path")), per.select("repo", F.lit(True).alias("declares")).distinct(), "repo", F.col("id"))
    spots = known.where("declares").where(F.col("path").isNotNull()).withColumn("folder", F.explode(above)).select("id", "path", F.length("folder").alias("depth"), spot.alias("spot"))
    hits = look_up(stored(spots, "spots"), per.select("spot", "rules"), "spot", F.col("id"))
    covering = F.expr("filter(rules, r -> rlike(substring(path, depth + 1), r.regex))")
    last = F.array_max(F.transform(covering, lambda r: F.struct(r["line"].alias("line"), r["marked"].alias("marked"))))
    marks = hits.withColumn("last", last).where(F.col("last").isNotNull()).groupBy("id").agg(F.max_by("last.marked", "depth").alias("marked"))
    return known.where("declares").select("id", "declares").distinct().join(marks, "id", "left")


def mined(proof: DataFrame) -> DataFrame:
    """``feature``: patterns of paths worth applying; ``proof`` has features, repo, convention and proven.

    Of the files that the default rules mark, texts prove a share ``q`` (1 if there are none);
    a pattern with a share ``s`` of proven files then holds about ``s / q`` that nobody wrote.
    """
    p = F.col("proven").cast("int")
    base, q = proof.agg(F.avg(p), F.avg(F.when(F.col("convention"), p))).first()
    each = proof.select(F.explode("features").alias("feature"), "repo", p.alias("p"))
    # repositories are counted from pre-aggregated pairs, so a hot one weighs one row
    pairs = each.groupBy("feature", "repo").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"))
    whole = pairs.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.when(F.col("p") > 0, 1).otherwise(0)).alias("repos"))
    share = F.col("p") / F.col("n")
    return whole.where((share >= PURITY * (q or 1.0)) & (share >= 4 * (base or 0.0)) & (F.col("p") >= SUPPORT) & (F.col("repos") >= REPOS)).select("feature")


def not_by_hand(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """``id``, ``reason`` (declared, convention, mined, or the text's: generated, vendored, minified, data) and ``text`` (what the text says, or null)."""
    rows = stored(evidence(df, key), "evidence")
    rows = rows.select("id", "repo", "features", "says", "convention").join(stored(declared(rows), "declared"), "id", "left")
    proven = F.coalesce("marked", F.col("says").isNotNull())
    patterns = stored(mined(rows.select("features", "repo", "convention", proven.alias("proven"))), "patterns")
    matched = rows.where(F.col("declares").isNull()).select("id", F.explode("features").alias("feature")).join(patterns, "feature").select("id").distinct().withColumn("mined", F.lit(True))
    # attribute files cover their own repository; patterns stand in where there is none
    by_pattern = F.col("declares").isNull()
    reason = (
        F.when(F.col("marked"), "declared").when(F.col("marked").isNotNull(), F.lit(None)).when(by_pattern & F.col("convention"), "convention").when(by_pattern & F.col("mined"), "mined").otherwise(F.col("says"))
    )
    return rows.join(matched, "id", "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).select("id", "reason", F.col("says").alias("text"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "apply_samples").select("sample_id", "repo", "path", "language", "original_code"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_by_hand(_rows(spark, sf_dir)).select(F.col("id").alias("sample_id")).distinct()


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per reason, and how many of them their text proves too."""
    return not_by_hand(_rows(spark, sf_dir)).groupBy("reason").agg(F.countDistinct("id").alias("files"), F.count("text").alias("proven_by_text"))


QUERIES = {"p1_found": (p1_found, None), "p1_reasons": (p1_reasons, None)}
