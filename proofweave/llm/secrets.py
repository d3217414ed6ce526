"""Secret scan: wide candidate patterns, then a random forest that removes the false positives.

A candidate is a key in the form of an issuer (web tokens and private key blocks are such forms), any run of at least 6
visible characters assigned with ``=`` or ``:``, with or without blanks around the sign, or a run of at least 12 key
characters. A quoted value under a secret-like name is read to its closing quote, whatever it holds; other values end at
white space, a quote or a separator before the next assignment, less closing punctuation. The forest sees its length,
character kinds and transitions, entropy, how much of it dictionary words cover, the path it was found under and the words
around it. It is trained from labelled findings (candidate, label); the dictionary comes from the texts of the same findings.
Trees are plain arrays, so a scan applies them to a whole batch of candidates.

``label_by_form`` labels findings where no reviewed ones are at hand: issuer-prefixed keys and values with digits assigned
to a secret-like name are secrets, words and numbers without such a name are not. All other forms are unknown: nothing is
learnt from them, and the forest decides; without a forest they are not masked.

At most ``sample`` different findings (half of each label, those with the smallest hashes) of all documents outside the
held-out fold train the forest; their features are computed in the tasks. Every text is scanned as a whole, and no pattern
reads a run of characters more than a few times. A private key block counts from its BEGIN to its END line, header lines
included, if what stands between is coded; without an END line its runs are candidates like any others. Null and empty texts hold no candidate. A null path is an empty path, and so is that of a table without the path column.
With findings of one label only, every candidate gets that label; without findings, ``train`` gives None and
``label_by_form`` decides. Repeated rows are scanned as often as they occur. Empty table: no rows.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fold, settle, texts_of

SAMPLE = 20_000
CONTEXT = 32
TREES, DEPTH, BINS = 24, 9, 24
RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
ASSIGNED = re.compile(r"""[=:]>?[ \t]{0,4}(?:"((?:[^"\\\n]|\\.){6,})"|'((?:[^'\\\n]|\\.){6,})'|["']?(?!//)((?:(?![,;&?]["']?[\w.\-]+["']?\s?[=:])[^\s"']){6,}))""")
_NAMED = re.compile(r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)\W{0,8}$")
#: each alternative starts at most once in a run of its characters, so long runs cost one pass
_ISSUED = re.compile(
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|npm_[A-Za-z0-9]{36}|(?<![A-Za-z0-9\-])xox[abp]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_\-]{35}|sk_live_[0-9A-Za-z]{16,}+"
    r"|(?<![A-Za-z0-9_\-])glpat-[A-Za-z0-9_\-]{20,}+|(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}+\.eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+"
)
_INSIDE = re.compile(rf"(?<![A-Za-z0-9])(?:{_ISSUED.pattern})(?![A-Za-z0-9])")
#: a private key block from its first to its last line, header lines allowed; nothing in it is tried twice
_BLOCK = re.compile(
    r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY-----(?:\s|\\[nr])*+(?:[A-Za-z][\w\-]{0,40}:[^\n]*+\n\s*+)*+"
    r"((?:[A-Za-z0-9+/=\s]|\\[nr])*+)-----END [A-Z0-9 ]{0,24}PRIVATE KEY-----"
)
_CODED = re.compile(r"[A-Za-z0-9+/=]{16,}")
_CLOSING = ",;:.)]}>"
_PLAIN = re.compile(r"\d+|[^\W\d_a-z]?[a-z]{2,}(?:[^\W\d_a-z][a-z]{2,})*|[A-Z]+|[^\W\d_a-zA-Z]+|[^\W\d_]")
_LETTERS = re.compile(r"[a-z]{3,}")
HASHED = 12
FEATURES = 18 + 2 * HASHED


def _is_key_block(m: re.Match) -> bool:
    """Whether most of what stands between the lines is coded, in runs longer than words."""
    body = re.sub(r"\\[nr]|\s", "", m.group(1))
    return bool(body) and 2 * sum(len(r) for r in _CODED.findall(m.group(1))) >= len(body)


def _issued(text: str) -> list[tuple[int, int]]:
    """Spans of keys in the form of an issuer, left to right."""
    blocks = [m.span() for m in _BLOCK.finditer(text) if _is_key_block(m)] if "PRIVATE KEY" in text else []
    return sorted(blocks + [s for m in _INSIDE.finditer(text) if not _meets(blocks, *(s := m.span()))])


def _meets(spans: list[tuple[int, int]], a: int, z: int) -> bool:
    """Whether a..z touches one of the spans, which are sorted and apart."""
    k = bisect.bisect_left(spans, (z,)) - 1
    return k >= 0 and spans[k][1] > a


def candidates(text: str) -> list[tuple[int, str, str, str]]:
    """(start, candidate, text before, text after) of each candidate, left to right; candidates do not overlap."""
    issued = _issued(text)
    spans, at = [], 0
    while m := ASSIGNED.search(text, at):
        a, z = m.span(m.lastindex)
        at = z
        named = _NAMED.search(text, max(0, m.start() - CONTEXT), m.start())
        sentence = m.lastindex < 3 and not named and any(c.isspace() for c in text[a:z])
        if sentence:  # its first word is assigned
            at = z = a + next(k for k, c in enumerate(text[a:z]) if c.isspace())
        if sentence or m.lastindex == 3:
            while z > a and text[z - 1] in _CLOSING:
                z -= 1
        # an issued key within a longer value without a name stands for itself
        if z - a >= 6 and (named or not _meets(issued, a, z)):
            spans.append((a, z))
    spans = sorted(spans + [s for s in issued if not _meets(spans, *s)])
    spans = sorted(spans + [s for m in RUN.finditer(text) if not _meets(spans, *(s := m.span()))])
    return [(a, text[a:z], text[max(0, a - CONTEXT) : a], text[z : z + CONTEXT]) for a, z in spans]


def label_by_form(found: str, before: str) -> int | None:
    """1 for a secret, 0 for words and numbers, None for an unknown form."""
    if _ISSUED.fullmatch(found) or ((m := _BLOCK.fullmatch(found)) and _is_key_block(m)):
        return 1
    digits = sum(c.isdigit() for c in found)
    if _NAMED.search(before):
        return 1 if 3 <= digits < len(found) else None
    return 0 if all(_PLAIN.fullmatch(part) for part in re.split(r"[\W_]+", found) if part) else None


def coverage(found: str, words: frozenset[str]) -> float:
    """Share of the characters that dictionary words of three letters or more cover, longest first from each place."""
    covered = 0
    for m in _LETTERS.finditer(found.lower()):
        run, at = m.group(), 0
        while at < len(run) - 2:
            n = next((n for n in range(min(12, len(run) - at), 2, -1) if run[at : at + n] in words), 0)
            covered += n
            at += n or 1
    return covered / len(found)


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % HASHED


def features(found: str, before: str, after: str, path: str, words: frozenset[str]) -> list[float]:
    n = len(found)
    kind = ["a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "." for c in found]
    moves = Counter(a + b for a, b in zip(kind, kind[1:], strict=False) if a != b)
    counts = Counter(found)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    run = max((len(m.group()) for m in re.finditer(r"[A-Za-z]+", found)), default=0)
    numeric = [
        n, kind.count("a") / n, kind.count("A") / n, kind.count("9") / n, kind.count(".") / n,
        (moves["a9"] + moves["9a"]) / n, (moves["A9"] + moves["9A"]) / n, (moves["aA"] + moves["Aa"]) / n, sum(moves.values()) / n,
        entropy, entropy / math.log2(max(2, n)), run / n, float(all(c in "0123456789abcdefABCDEF" for c in found)),
        coverage(found, words), float(bool(_NAMED.search(before))), float(before[-1:] in ("=", ":", '"', "'")), float(after[:1] in ('"', "'", ";", ",")), len(path),
    ]
    near = np.zeros(2 * HASHED)
    for w in re.findall(r"\w+", before)[-2:] + re.findall(r"\w+", after)[:2]:
        near[_bucket(w.lower())] += 1
    for w in re.findall(r"\w+", path):
        near[HASHED + _bucket(w.lower())] += 1
    return numeric + near.tolist()


class Forest:
    """Random forest on binned features; each tree is four arrays."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        self.n, self.depth, self.seed, self.trees, self.share = trees, depth, seed, [], 0.0
        self.words: frozenset[str] = frozenset()

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        r = np.random.default_rng(self.seed)
        self.share = float(y.mean()) if len(y) else 0.0
        if not 0 < self.share < 1:
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)])
        for _ in range(self.n):
            rows = r.integers(0, len(y), len(y))
            self.trees.append(self._grow(binned, y, rows, edges, r))
        return self

    def _grow(self, binned, y, rows, edges, r):
        feature, split, left, value = [], [], [], []
        todo = [(rows, 0, None)]
        while todo:
            rows, depth, slot = todo.pop()
            node = len(feature)
            if slot is not None:
                left[slot[0]][slot[1]] = node
            feature.append(-1), split.append(0.0), left.append([node, node]), value.append(float(y[rows].mean()))
            if depth == self.depth or len(rows) < 4 or value[-1] in (0.0, 1.0):
                continue
            best = None
            for f in r.choice(binned.shape[1], 7, replace=False):
                if not len(edges[f]):
                    continue
                total = np.bincount(binned[rows, f], minlength=len(edges[f]) + 1)[:-1].cumsum()
                ones = np.bincount(binned[rows, f], weights=y[rows], minlength=len(edges[f]) + 1)[:-1].cumsum()
                other, rest = len(rows) - total, y[rows].sum() - ones
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.nan_to_num(ones**2 / total) + np.nan_to_num(rest**2 / other)
                gain[(total == 0) | (other == 0)] = -1
                k = int(gain.argmax())
                if gain[k] > 0 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k)
            if best is None:
                continue
            _, f, k = best
            feature[node], split[node] = int(f), float(edges[f][k])
            low = binned[rows, f] <= k
            todo += [(rows[low], depth + 1, (node, 0)), (rows[~low], depth + 1, (node, 1))]
        return np.array(feature), np.array(split), np.array(left), np.array(value)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.share)
        total = np.zeros(len(x))
        for feature, split, left, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                at = left[at, (x[np.arange(len(x)), np.maximum(f, 0)] >= split[at]).astype(int)]
            total += value[at]
        return total / len(self.trees)


def _paths(docs: DataFrame, path: str | None):
    return F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")


def labelled_findings(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """found, before, after, path, label by ``label_by_form`` (null if unknown) for all documents outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", _paths(docs, path).alias("path")).where(fold(F.col("doc_id"), 3) != 1)

    def run(batches):
        for batch in batches:
            out = [(f, b, a, p or "", label_by_form(f, b)) for t, p in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True) for _, f, b, a in candidates(t)]
            yield pa.RecordBatch.from_pydict({n: pa.array([o[k] for o in out], pa.int32() if n == "label" else pa.string()) for k, n in enumerate(("found", "before", "after", "path", "label"))})

    return rows.select("text", "path").mapInArrow(run, "found string, before string, after string, path string, label int")


def train(findings: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Forest from labelled findings (found, before, after, path, label), at most ``sample // 2`` of each label; None without any."""
    columns = ["found", "before", "after", "path", "label"]
    # written out: both labels come from one pass over the texts
    known = cut(findings.where("label is not null and found <> ''").select(*columns, F.xxhash64(*columns).alias("k")))
    # the smallest hashes of each label, equal findings once; the driver sees contexts and features, never a value
    keys = [known.where(F.col("label") == v).select("k").distinct().orderBy("k").limit(sample // 2) for v in (0, 1)]
    chosen = cut(known.join(F.broadcast(keys[0].union(keys[1])), "k", "left_semi").dropDuplicates(["k"]))
    near = chosen.select("k", "before", "after").collect()
    if not near:
        return None
    forest = Forest()
    counts = Counter(w for r in near for w in re.findall(r"[a-z]{3,12}", f"{(r.before or '')[-CONTEXT:]} {(r.after or '')[:CONTEXT]}".lower()))
    words = forest.words = frozenset(w for w, n in counts.items() if n >= 3)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            x = [features(r["found"], r["before"] or "", r["after"] or "", r["path"] or "", words) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(batch.schema.get_field_index("label"))], names=["k", "x", "label"])

    rows = sorted(chosen.select("k", *columns).mapInArrow(run, "k long, x array<double>, label int").collect())
    return forest.fit(np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r.label for r in rows], float))


def judged(texts: list[str], paths: list[str], forest: Forest | None) -> list[list[tuple[int, str, float]]]:
    """(start, candidate, score) of all candidates of each text."""
    found = [candidates(t) for t in texts]
    if forest is None:
        return [[(s, f, float(label_by_form(f, b) or 0)) for s, f, b, _ in c] for c in found]
    x = [features(f, b, a, p, forest.words) for c, p in zip(found, paths, strict=True) for _, f, b, a in c]
    scores = iter(forest.score(np.array(x).reshape(-1, FEATURES)).tolist())
    return [[(s, f, next(scores)) for s, f, _, _ in c] for c in found]


def scan(docs: DataFrame, forest: Forest | None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per secret: doc_id, start (character), length, secret_sha256, score."""
    import hashlib

    bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            out = judged(texts_of(batch.column(1)), batch.column(2).to_pylist(), forest)
            rows = [(k, s, len(f), hashlib.sha256(f.encode("utf-8", "surrogatepass")).hexdigest(), p) for k, c in zip(batch.column(0).to_pylist(), out, strict=True) for s, f, p in c if p >= threshold]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64())
            names = ("doc_id", "start", "length", "secret_sha256", "score")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))

    rows = docs.select("doc_id", "text", _paths(docs, path).alias("path"))
    return rows.mapInArrow(run, f"doc_id {key.simpleString()}, start long, length long, secret_sha256 string, score double")


def redact(docs: DataFrame, forest: Forest | None, path: str | None = "source", threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """All rows of ``docs`` with their columns; secrets in ``text`` replaced by ``mask``, ``n_chars`` brought up to date."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    where = docs.columns.index(path) if path in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            paths = [str(p or "") for p in batch.column(where).to_pylist()] if where is not None else [""] * len(texts)
            for k, c in enumerate(judged([t or "" for t in texts], paths, forest)):
                pieces, done = [], 0
                for s, f, p in c:
                    if p >= threshold:
                        pieces += [texts[k][done:s], mask]
                        done = s + len(f)
                if done:
                    texts[k] = "".join([*pieces, texts[k][done:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        settle()

    clean = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.coalesce(length, F.col("n_chars"))))
    return clean
