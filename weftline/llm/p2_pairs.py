"""Problem 2: broken pairs of an edit snippet and an answer.

Ordered rules look at the content of the answer: nothing in it; a refusal, in
several languages and also as a comment; a copy of the snippet or of the
original; another programming language (by the marks of its lines) or prose
in another language (by script and function words); an end before the end of
the file, by the lines of the original that the answer never reaches, or by
delimiters that stay open. ``defects`` gives every rule that fires, in this
order, and the first is the defect of the pair. Rules look at whole texts of any
length; only a very long line is first cut at its delimiters.

Defined results: null, blank and ``ERROR`` contents are empty; a null language
can't be missed; without an original the complete file, if there is one, tells
whether an answer was cut, else open delimiters and a last line that breaks off; repeated rows are judged
alike; texts are read whole; an empty table gives no rows; other columns are
dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from .languages import language_of, likely

WIDE = 200  # a longer line is compared by its pieces
MISSING = 0.09  # least share of the original's characters that a cut answer never reaches

#: Phrases that decline a request, in English, German, French and Spanish.
_REFUSES = re.compile(
    r"(?i)\b(?:i(?:'m| am)? (?:really |very |so |afraid )?(?:sorry|afraid)|my apologies|apologi[sz]e|unfortunately|regrettably|i (?:can(?:no|')t|cannot|am unable|won't|will not|must decline|have to decline|decline|refuse)|can't (?:help|assist)|unable to (?:help|assist|comply|produce|complete|apply|process|do|provide|make|merge)|not able to|not possible for me|isn't possible|is not possible|have to decline|as an ai|against (?:my|the) (?:policy|guidelines)|access denied|"
    r"es tut mir leid|tut mir leid|entschuldigung|leider|kann ich nicht|ich kann (?:das|diese|dir|ihnen|hier)?\s*nicht|nicht möglich|"
    r"désolée?|je (?:ne peux|ne suis) pas|je regrette|malheureusement|impossible de|je dois refuser|"
    r"lo siento|no puedo|lamentablemente|lamento|me temo|no es posible|disculp)"
)
#: Frequent function words of prose.
_WORDS = {
    "en": frozenset("the a an and or of to in is are was it this that for with on as by be not i you we can could will would have has please".split()),
    "de": frozenset("der die das und oder nicht ist ein eine den dem des zu mit auf für wird werden nach jede jeden alle wenn weil bevor ohne unser unsere".split()),
    "fr": frozenset("le la les des et ou ne pas est un une du de que qui dans pour avec sur après avant chaque toutes sans notre quand car".split()),
    "es": frozenset("el la los las y o no es un una del de que en para con por después antes cada todas sin nuestro cuando porque faltaban".split()),
}
_PREFIX = re.compile(r"^\s*(?://+|#+|--|;+|/\*+|\*+/?|<!--|\"\"\"|''')?\s*|\s*(?:\*/|-->|\"\"\"|''')?\s*$")
_NOTE = re.compile(r"\s*(?:/[/*]|#|--|;|\*|<!--|\"\"\"|''')")
_JOINTS = re.compile(r"\s*\n\s*(?://+|#+|--|;+|/\*+|\*+/?|<!--|\"\"\"|''')?\s*")
_LATIN = re.compile(r"[a-zà-öø-ÿœß']+")
_OTHER_SCRIPT = re.compile(r"[Ͱ-῿Ⰰ-퟿豈-﷿\U00010000-\U0003ffff]")
_CODE = re.compile(r"[{};=<>\[\]]|\w\(|:$|^\s*[#@]\w")
_STATEMENT = re.compile(r"(?i)^\s*(?:select\b.+\bfrom|insert into|update \w+ set|delete from|create (?:table|index|view)|alter table|drop table)\b")
_PIECES = re.compile(r"[^;{}<>,]*[;{}<>,]|[^;{}<>,]+")
#: Pairs in which a text of the first language is usually valid in the second, so marks decide only with a wide margin.
_KIN = {("javascript", "typescript"), ("c", "c++"), ("json", "yaml"), ("json", "javascript")}


def content(raw: str | None) -> str | None:
    """The answer inside its wrapper; the whole value without one."""
    if raw is None:
        return None
    start = raw.find("<update_file>")
    if start < 0:
        return raw
    body = raw[start + len("<update_file>") :]
    end = body.rfind("</update_file>")
    return body if end < 0 else body[:end]


def is_empty(text: str | None) -> bool:
    return text is None or not text.strip() or text.strip() == "ERROR"


def prose(lines: list[str]) -> str | None:
    """The language of lines that are prose, not code; ``other`` for another script; None for code."""
    # lines that bear no sign of a comment are most of a file, and may tell without being stripped
    if sum(1 for x in lines if _CODE.search(x) and not _NOTE.match(x) and not x.rstrip().endswith("-->")) > 0.2 * len(lines):
        return None
    bare = [_PREFIX.sub("", x) for x in lines]
    text = " ".join(x for x in bare if x)
    if not text:
        return None
    coded = sum(1 for x in bare if _CODE.search(x))
    if coded > 0.2 * len(bare):
        return None
    letters = sum(c.isalpha() for c in text)
    if len(_OTHER_SCRIPT.findall(text)) > 0.3 * max(1, letters):
        return "other"
    words = _LATIN.findall(text.lower())
    if len(words) < 5:
        return None
    hits = {k: sum(w in s for w in words) / len(words) for k, s in _WORDS.items()}
    best = max(hits, key=hits.__getitem__)
    return best if hits[best] >= 0.12 else None


def refuses(text: str, original: str | None = None) -> bool:
    """Prose without code that declines, of any length.

    It opens by declining, or declines once in about twelve lines; a text that
    repeats a third of its lines from the original is a file that mentions such words.
    """
    if not _REFUSES.search(_JOINTS.sub(" ", text).replace("\u2019", "'")):
        return False
    lines = [x for x in text.split("\n") if x.strip() and not re.match(r"\s*(?:```|~~~)", x)]
    if not lines:
        return False
    bare = [_PREFIX.sub("", x) for x in lines]
    joined = " ".join(bare).replace("\u2019", "'")
    hits = sum(1 for _ in _REFUSES.finditer(joined))
    if not hits or 12 * hits < len(lines) and not _REFUSES.search(bare[0].replace("\u2019", "'")):
        return False
    if sum(1 for x in bare if re.search(r"[{};]\s*$|\w\(.*\)\s*[:{]?$|\w\s*=\s*\S", x)) > 0.34 * len(bare):
        return False
    known = {x.strip() for x in (original or "").split("\n")}
    return 3 * sum(x.strip() in known for x in lines) < len(lines)


def other_language(text: str, language: str | None, original: str | None) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    spoken = prose(lines)
    if spoken not in (None, "en"):
        # documents may hold foreign lines; an original in the same language is no defect
        return prose([x for x in (original or "").split("\n") if x.strip()]) != spoken
    if language is None:
        return False
    before = [x.strip() for x in (original or "").split("\n") if len(x.strip()) > 6]
    if before:
        own = {x.strip() for x in lines if len(x.strip()) > 6}
        if len(own & set(before)) >= 0.3 * max(1, min(len(own), len(set(before)))):
            return False
    marks = likely(lines)
    if language not in marks:
        return False
    best = max(marks, key=marks.__getitem__)
    # English prose without code may begin like a statement of SQL
    if best == language or marks[best] < 0.15 or spoken == "en" and language != "markdown" and not code_like(lines):
        return False
    wide = (language, best) in _KIN or (best, language) in _KIN
    return marks[best] >= marks[language] * (1.3 if wide else 1.15) + (0.05 if wide else 0.03)


def code_like(lines: list[str]) -> bool:
    """Whether any line bears the signs of code beyond those that prose has too."""
    return any(_CODE.search(x) or _STATEMENT.search(x) for x in lines)


def units(text: str) -> list[str]:
    """The lines that aren't blank; one of more than ``WIDE`` characters comes in the pieces between its delimiters."""
    out = []
    for x in text.replace("\r", "\n").split("\n"):
        if x.strip():
            out += _PIECES.findall(x) if len(x) > WIDE else [x]
    return out


def truncated(text: str, original: str | None, snippet: str | None) -> bool:
    """Whether the answer never reaches the last part of the original."""
    if is_empty(original):
        return False
    answer = [x.strip() for x in units(text)]
    laid = units(original)
    lines = [x.strip() for x in laid]
    if not answer or not lines:
        return False
    gone = "\n".join(re.findall(r"(?im)^\W*(?:remove|delete|drop)[sd]?:?\s+(.+)$", snippet or ""))
    times = Counter(lines)
    have = set(answer)
    reached = 0
    for i in range(len(lines) - 1, -1, -1):
        x = lines[i]
        if x in have and len(x) > 5 and times[x] == 1:
            reached = i + 1
            break
    rest, at = [], reached
    while at < len(lines):
        x = lines[at]
        if gone and len(x) > 8 and x in gone:
            # what the snippet says is removed, with all that is indented below it, need not be reached
            depth = len(laid[at]) - len(laid[at].lstrip())
            at += 1
            while at < len(lines) and (len(laid[at]) - len(laid[at].lstrip()) > depth or re.fullmatch(r"[\])};,]+|end|fi|done|</\w+>", lines[at])):
                at += 1
            continue
        rest.append(x)
        at += 1
    missing = sum(len(x) + 1 for x in rest)
    whole = sum(len(x) + 1 for x in lines)
    if missing < MISSING * whole:
        return False
    # text of the answer behind the last line reached that replaces the rest
    behind = answer
    if reached:
        last = lines[reached - 1]
        behind = answer[len(answer) - answer[::-1].index(last) :]
    added = sum(len(x) + 1 for x in behind)
    inserted = {x.strip() for x in (snippet or "").split("\n") if x.strip()}
    own = sum(len(x) + 1 for x in behind if x in inserted)
    return added - own < 0.4 * missing or sum(len(x) + 1 for x in answer) < 0.85 * whole and added < 0.5 * missing


def breaks_off(text: str) -> bool:
    """The last line ends inside a word, list or expression while delimiters are open."""
    last = text.rstrip().rsplit("\n", 1)[-1]
    return bool(re.search(r"[,({\[=+\-*/&|.]$|\b(?:and|or|return|if|def|function)$", last)) and text.count("(") + text.count("{") + text.count("[") > text.count(")") + text.count("}") + text.count("]")


def defects(answer: str | None, snippet: str | None, original: str | None, language: str | None, both: bool, whole: str | None = None) -> list[str]:
    """Every rule that fires, the strongest first; ``both``: an empty snippet counts too; ``whole``: a complete file to measure by without an original."""
    if is_empty(answer) or both and is_empty(snippet):
        return ["empty"]
    out = []
    if refuses(answer, whole if is_empty(original) else original):
        out.append("refusal")
    bare = answer.strip()
    if any(x is not None and x.strip() == bare for x in (snippet, original)):
        out.append("copy")
    if other_language(answer, language_of(language), original):
        out.append("other_language")
    measure = whole if is_empty(original) else original
    if truncated(answer, measure, snippet) or is_empty(measure) and breaks_off(answer):
        out.append("truncated")
    return out


def judge(df: DataFrame, both: bool) -> DataFrame:
    """``record_id`` and ``defects`` of (record_id, answer, snippet, original, language, whole); sound pairs are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *rest = (c.to_pylist() for c in batch.columns)
            found = [(i, d) for i, (a, s, o, g, w) in zip(ids, zip(*rest)) if (d := defects(a if both else content(a), s, o, g, both, w))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.string()), pa.array([d for _, d in found], pa.list_(pa.string()))], ["record_id", "defects"])

    return df.select("record_id", "answer", "snippet", "original", "language", "whole").mapInArrow(run, "record_id string, defects array<string>")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_table``, ``record_id`` and ``defects`` over both tables."""
    a = table(spark, sf_dir, "apply_samples").select(F.col("sample_id").cast("string").alias("record_id"), F.col("prediction_raw").alias("answer"), F.col("update_snippet").alias("snippet"), F.col("original_code").alias("original"), "language", F.when(F.trim(F.coalesce("original_code", F.lit(""))) == "", F.col("ground_truth")).alias("whole"))
    j = table(spark, sf_dir, "judged_samples").select(F.col("custom_id").alias("record_id"), F.col("final_code").alias("answer"), F.col("update_snippet").alias("snippet"), F.col("original_code").alias("original"), "language", F.lit(None).cast("string").alias("whole"))
    out = [judge(spread(d), both).select(F.lit(name).alias("source_table"), "record_id", "defects") for d, name, both in ((a, "apply_samples", False), (j, "judged_samples", True))]
    return out[0].union(out[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("source_table", "record_id", F.col("defects")[0].alias("defect")).distinct()


def p2_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per table and defect, counting every rule that fired; a refusal or a snippet sent back is also cut where it lacks the end of the file."""
    return pairs(spark, sf_dir).select("source_table", F.explode("defects").alias("defect")).groupBy("source_table", "defect").agg(F.count(F.lit(1)).alias("pairs"))


QUERIES = {"p2_found": (p2_found, None), "p2_defects": (p2_defects, None)}
