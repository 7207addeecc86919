"""Problem 7: credentials embedded in source code, found and blotted out.

Lines that name a credential or hold something shaped like one give candidate
values. Each is described by the likelihood of its characters under a Markov
model of the values in all rows, the identifiers before it on the line,
its shape and the path (``FEATURES``). A logistic regression is trained on
weak labels, which patterns give to the clear cases of at most ``SAMPLE``
rows; its calibrated score decides about every candidate of every row, all
candidates of a batch at once. One scan counts the pairs of characters and
picks the lines to train on, a second one scores.

Defined results: null and blank texts have no credentials; a text that occurs
in several rows is searched in each; very long texts and lines are searched
whole; without candidates to train on, the weak labels decide; an empty table
gives no rows; other columns are dropped. Redaction replaces each letter and
digit of the value by ``x`` and keeps everything else.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, stored, table

KEPT = 4  # short quoted names before a value that can be its keys
UNIT = 1000  # parts of a character in counts
WEIGHT = 64  # characters that a value counts for at most in the Markov model
LEAST = 4  # characters of a value
SAMPLE = 3000  # rows that the regression is trained on
FIELDS = ("original_code", "ground_truth")

#: Shapes of well-known tokens.
_KNOWN = r"""sk_live_\w{8,}|sk_test_\w{8,}|rk_live_\w{8,}|gh[pousr]_\w{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{10,}|(?:AKIA|ASIA)[A-Z0-9]{12,}|AIza[\w-]{30,}|npm_\w{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{4,}\.[\w-]{4,}"""
_KNOWN_RE = re.compile(rf"(?<![A-Za-z0-9])(?:{_KNOWN})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@'\"`<>]*:([^\s/@'\"`]+)@")
_HEADER = re.compile(r"\b(?:[Bb]asic|[Bb]earer|BASIC|BEARER)\s+([A-Za-z0-9+/=._~-]{8,})")
_INNER = re.compile(r"(?i)\b(?:password|pwd|passwd|secret|accountkey|sharedaccesskey|api_?key|token)\s*=\s*([^;\s'\"`]{6,})(?=;|$)")
#: Words that must stand on a line for its values to be looked at, and what always counts.
_TRIGGER = re.compile(
    r"[Pp]ass|PASS|[Pp]wd|PWD|\bpw\b|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Kk]ey|KEY|[Cc]redential|CREDENTIAL|[Aa]uth|AUTH|[Ll]ogin|LOGIN|PRIVATE KEY|"
    r"://[^\s/]*:[^\s/]*@|[Bb]asic |[Bb]earer |\b(?:sk_|rk_|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|AKIA|ASIA|AIza|npm_|SG\.|eyJ)"
)
_VALUE = re.compile(r"(?P<q>[\"'`])(?P<s>(?:\\.|(?!(?P=q)).)+?)(?P=q)|(?:[=:]|->|\b[iI]s\b|\bto\b)[ \t]*(?P<u>[^\s\"'`,;<>(){}\[\]][^\s\"'`,;<>()\[\]]{4,}|<[\w-]+>)|>(?P<x>[^<>\s]{6,})<")
_NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_STRONG = re.compile(
    r"passw(?:or)?d|passphrase|\bpwd\b|\bpw\b|\bpass\b|secret|credential|(?:api|access|private|signing|secret|encryption|service|account|master|deploy|ssh) ?key|(?:auth|access|private|refresh|bearer|api|session|deploy|bot|temp|personal) ?token|apikey|\bkey for\b|\btoken is\b"
)
_BROAD = re.compile(r"\b(?:token|key|auth|login|session|client|cred)s?\b")
_BENIGN = re.compile(
    r"\b(?:digest|hash|sha|md5|etag|uuid|guid|checksum|commit|revision|label|public|verify|fingerprint|prompt|hint|title|message|text|placeholder|field|param|name|retry|count|length|size|version|pattern|regex|format|url|path|file|id)s?\b"
)
_STAND_IN = re.compile(
    r"(?i)^\W*$|\$\{|\{\{|%\(|^<[^>]*>$|^\$\w|^%\w+%$|x{6,}|\*{4,}|\.{3,}|^(?:change|replace|insert|fill|put|set|enter|use|add)[-_ ]?(?:me|this|it|here|your|in)\b|change[-_]?me|replace[-_]?me|your[-_ ]|[-_ ]here\b|example|dummy|sample|^todo|redacted|placeholder|^none$|^null$|^undefined$|^(?:vault|env|secret|ssm|file|arn|op|ref|gcp|aws|azure|keyvault|sops|kms)[:/]|environ|getenv|process\.env|^@\w"
)
_UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?$")
_HEX = re.compile(r"^(?:0x)?(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")
_PLAIN = re.compile(r"^[a-z]+(?:[-_./ ][a-z]+)*(?:[-_./ ]?\d+)?$|^[a-z]+(?:[A-Z][a-z]*)*$|^[\d.,:_-]+$|^[A-Za-z]+(?:[_ .][A-Za-z0-9]+)*$")
_COMMENT = re.compile(r"^\s*(?://|#(?!define)|--|/\*|\*|<!--|;|\"\"\")")
_TEST = re.compile(r"(?i)(?:^|[/_.-])(?:tests?|spec|fixtures?|examples?|docs?|samples?)(?:[/_.-]|$)")
_CONFIG = re.compile(r"(?i)\.(?:ya?ml|json|ini|cfg|conf|env|properties|toml|xml|md|sh)$")
FEATURES = "markov entropy length digits upper symbols space known login header strong broad benign stand_in uuid hex plain comment quoted test config named hinted shaped".split()

_REFERS, _UUID_AT = FEATURES.index("stand_in"), FEATURES.index("uuid")


class Markov:
    """Log-likelihood of characters given the one before, in bits a character."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        first: Counter = Counter()
        for (a, _), n in pairs.items():
            first[a] += n
        self.bits = {k: math.log2((first[k[0]] + 48) / (n + 0.5)) for k, n in pairs.items()}
        self.rare = {a: math.log2((n + 48) / 0.5) for a, n in first.items()}

    def __call__(self, value: str) -> float:
        if len(value) < 2:
            return 0.0
        bits, rare = self.bits, self.rare
        return sum(bits.get(p) or rare.get(p[0], 7.0) for p in zip(value, value[1:])) / (len(value) - 1)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(line: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, text before) of each value on a line that may be a credential."""
    taken, kept = 0, deque(maxlen=KEPT)
    for m in _VALUE.finditer(line):
        k = m.lastgroup if m.lastgroup != "q" else "s"
        k = "s" if m.group("s") is not None else "u" if m.group("u") is not None else "x"
        start, end = m.span(k)
        before = line[taken : m.start() + 1]
        value = m.group(k)
        for shape, kind in ((_LOGIN, "login"), (_HEADER, "header"), (_INNER, "login")):
            if h := shape.search(value):
                yield start + h.start(1), start + h.end(1), kind, before
                break
        else:
            if end - start >= LEAST and not value.startswith("-----BEGIN"):
                yield start, end, "quoted" if k == "s" else "bare", before
        if k == "u" and value.isidentifier():
            continue  # a type between a name and its value
        if end - start >= 40 or " " in value or k != "s" or _BENIGN.search(value) is None and _STRONG.search(" ".join(_NAMES.findall(value)).lower()) is None:
            taken = m.end()
            kept.clear()
        else:
            # a short quoted name stays in view, as the key of the value after it; of many in a row the last ones
            if len(kept) == KEPT:
                taken = kept[0]
            kept.append(m.end())
    for shape, group, kind in ((_LOGIN, 1, "login"), (_HEADER, 1, "header"), (_KNOWN_RE, 0, "known")):
        seen = 0
        for h in shape.finditer(line):
            yield h.start(group), h.end(group), kind, line[seen : h.start()]
            seen = h.end()


def describe(line: str, start: int, end: int, kind: str, before: str, path: str, markov: Markov) -> list[float]:
    value = line[start:end]
    names = " ".join(w.lower() for w in _NAMES.findall(before.rpartition(";")[2]))  # of the same statement
    n = max(1, len(value))
    row = [
        markov(value) / 8, entropy(value) / 5, min(n, 64) / 32, sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n,
        sum(not c.isalnum() for c in value) / n, float(" " in value), float(kind == "known" or bool(_KNOWN_RE.match(value))), float(kind == "login"), float(kind == "header"),
        float(bool(_STRONG.search(names))), float(bool(_BROAD.search(names))), float(bool(_BENIGN.search(names))), float(bool(_STAND_IN.search(value))), float(bool(_UUID.match(value))),
        float(bool(_HEX.match(value))), float(bool(_PLAIN.match(value))), float(bool(_COMMENT.match(line))), float(kind == "quoted"), float(bool(_TEST.search(path))), float(bool(_CONFIG.search(path))),
    ]
    # a name counts otherwise beside a harmless one, and a shape of its own beside none
    strong, broad, benign = row[10:13]
    row += [float(strong and not benign), float(broad and not benign), float(kind in ("known", "login", "header"))]
    return [round(v, 9) for v in row]  # alike in any order of additions


def weak_label(x: list[float]) -> int | None:
    """1 or 0 for a clear case, None for the regression to decide."""
    f = dict(zip(FEATURES, x))
    if f["stand_in"] or f["uuid"]:
        return 0
    if f["known"] or f["login"] or f["header"]:
        return 1
    if f["space"] or (f["benign"] and not f["strong"]):
        return 0
    if f["strong"] and not f["benign"]:
        if f["plain"]:
            return 0
        return 1 if f["digits"] and (f["quoted"] or f["comment"] or f["config"]) else None
    return 0 if f["plain"] or not f["broad"] else None


class Logistic:
    """L2-regularised logistic regression by Newton steps, with Platt calibration by folds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.05, folds: int = 10):
        self.w = self._fit(x, y, ridge)
        held = np.zeros(len(y))
        at = np.arange(len(y))[np.lexsort(x.T)].argsort() % folds  # by the rows' own order, not that of the table
        for k in range(folds):
            out = at == k
            held[out] = self._raw(x[out], self._fit(x[~out], y[~out], ridge))
        self.scale = self._fit(held[:, None], y, 0.01)

    @staticmethod
    def _raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x @ w[:-1] + w[-1]

    def _fit(self, x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
        a = np.hstack([x, np.ones((len(x), 1))])
        w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probabilities of rows of features."""
        return 1 / (1 + np.exp(-np.clip(self._raw(x, self.w) * self.scale[0] + self.scale[1], -30, 30)))


class Detector:
    """What is learned: the Markov model and the regression (None: weak labels decide)."""

    def __init__(self, markov: Markov, model: Logistic | None, threshold: float = 0.5):
        self.markov, self.model, self.threshold = markov, model, threshold

    def hits(self, x: list[list[float]]) -> list[bool]:
        if not x:
            return []
        scored = (self.model.score(np.array(x)) >= self.threshold).tolist() if self.model else [weak_label(r) == 1 for r in x]
        # what refers to a variable or a store, or stands for a value, and a UUID are no credentials by definition
        return [hit and not r[_REFERS] and not r[_UUID_AT] for hit, r in zip(scored, x)]

    def find(self, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text (line from 1, start, end in the text) of each credential, in order, without overlaps."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        places, x = [], []
        for k, (text, path) in enumerate(zip(texts, paths)):
            if not text:
                continue
            # from trigger to trigger: lines without one are passed over in one search
            number, at = 1, 0
            while m := _TRIGGER.search(text, at):
                first = text.rfind("\n", at, m.start()) + 1 or at
                number += text.count("\n", at, first)
                end = text.find("\n", m.end())
                end = len(text) if end < 0 else end
                line = text[first:end]
                if b := _PEM.search(line):
                    # a key goes on to its end, over as many lines as it has
                    start = first + b.end()
                    e = _PEM_END.search(text, start)
                    found[k].append((number, start, e.start() if e else len(text)))
                    if not e:
                        break
                    stop = text.find("\n", e.end())
                    stop = len(text) if stop < 0 else stop
                    number += text.count("\n", first, stop)
                    end = stop
                else:
                    for start, stop, kind, before in candidates(line):
                        places.append((k, number, first + start, first + stop))
                        x.append(describe(line, start, stop, kind, before, path or "", self.markov))
                if end >= len(text):
                    break
                number, at = number + 1, end + 1
        last = (-1, -1)
        for k, number, start, end in sorted({p for p, hit in zip(places, self.hits(x)) if hit}):
            if (k, start) >= last:
                found[k].append((number, start, end))
                last = (k, end)
        return [sorted(f) for f in found]


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """Blot out: letters and digits become ``x``; escapes such as ``\\n`` and everything else stay."""
    out, at = [], 0
    for _, start, end in found:
        out += [text[at:start], re.sub(r"\\.|[^\W_]", lambda m: m.group() if m.group()[0] == "\\" else "x", text[start:end])]
        at = end
    return "".join([*out, text[at:]])


def train(df: DataFrame, key: str = "sample_id", sample: int = SAMPLE) -> Detector:
    """Train on the ``sample`` rows whose hash of ``key`` is least; pairs of characters are counted in all rows, in the same scan."""
    rank = F.xxhash64(key)
    bound = df.select(rank.alias("rank")).orderBy("rank").limit(sample).agg(F.max("rank")).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, long = Counter(), Counter()
        names = ["p", "n", "path", "line"]
        for batch in batches:
            lines = set()
            for picked, path, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                for text in texts:
                    for m in _VALUE.finditer(text or ""):
                        v = m.group("s") or m.group("u") or m.group("x")
                        if len(v) <= WEIGHT:
                            counts.update(zip(v, v[1:]))
                        else:  # long data don't outweigh all else; whole numbers add up alike in any order
                            for pair, n in Counter(zip(v, v[1:])).items():
                                long[pair] += n * WEIGHT * UNIT // len(v)
                    if picked and text:
                        lines |= {(path, line) for line in text.split("\n") if _TRIGGER.search(line) and not _PEM.search(line)}
            a, b = zip(*sorted(lines, key=str)) if lines else ((), ())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.string()), pa.nulls(len(a), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names)
        for pair, n in counts.items():
            long[pair] += n * UNIT
        items = [(a + b, n) for (a, b), n in long.items() if 32 <= ord(a) < 127 and 32 <= ord(b) < 127]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64()), pa.nulls(len(items), pa.string()), pa.nulls(len(items), pa.string())], names)

    seen = stored(df.select((rank <= F.lit(bound)).alias("picked"), "path", *FIELDS).mapInArrow(read, "p string, n long, path string, line string"), "lines")
    counted = seen.where(F.col("p").isNotNull()).groupBy("p").agg(F.sum("n").alias("n")).collect()  # at most 95 * 95
    markov = Markov({(r[0][0], r[0][1]): r[1] / UNIT for r in counted})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for path, line in zip(*(c.to_pylist() for c in batch.columns)):
                for start, end, kind, before in candidates(line):
                    x = describe(line, start, end, kind, before, path or "", markov)
                    if (y := weak_label(x)) is not None:
                        out.add((y, *x))
            out = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1:] for r in out], pa.list_(pa.float64()))], ["y", "x"])

    some = seen.where(F.col("line").isNotNull()).select("path", "line").distinct()
    data: pd.DataFrame = some.mapInArrow(rows, "y int, x array<double>").distinct().orderBy(F.xxhash64("x")).limit(20 * sample).toPandas()
    if data.y.nunique() < 2:
        return Detector(markov, None)
    return Detector(markov, Logistic(np.array(data.x.tolist()), data.y.to_numpy(float)))


def find(df: DataFrame, detector: Detector, key: str = "sample_id") -> DataFrame:
    """``key``, ``field``, ``line_no``, ``start`` and ``end`` (offsets in the text) of each credential."""
    held = df.sparkSession.sparkContext.broadcast(detector)  # bounded: bigrams and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = held.value
        for batch in batches:
            ids, paths, *texts = (c.to_pylist() for c in batch.columns)
            out = [(i, field, *hit) for field, column in zip(FIELDS, texts) for i, hits in zip(ids, d.find(column, paths)) for hit in hits]
            c = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(c, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["id", "field", "line_no", "start", "end"])

    picked = df.select(F.col(key).cast("long").alias("id"), "path", *FIELDS)
    return picked.mapInArrow(run, "id long, field string, line_no long, start long, end long").withColumnRenamed("id", key)


def blot(df: DataFrame, detector: Detector, key: str = "sample_id") -> DataFrame:
    """``key``, the two fields blotted out, and ``n_found``."""
    held = df.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = held.value
        for batch in batches:
            ids, path, *texts = (c.to_pylist() for c in batch.columns)
            found = [d.find(field, path) for field in texts]
            clean = [[redact(t, f) if f else t for t, f in zip(field, hits)] for field, hits in zip(texts, found)]
            n = [sum(map(len, x)) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in clean), pa.array(n, pa.int32())], ["id", *FIELDS, "n_found"])

    picked = df.select(F.col(key).cast("long").alias("id"), "path", *FIELDS)
    return picked.mapInArrow(run, "id long, original_code string, ground_truth string, n_found int").withColumnRenamed("id", key)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "apply_samples").select("sample_id", "path", *FIELDS))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rows(spark, sf_dir)
    return find(df, train(df)).select("sample_id", "field", "line_no").distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rows(spark, sf_dir)
    return blot(df, train(df))


QUERIES = {"p7_found": (p7_found, None), "p7_redacted": (p7_redacted, None)}
