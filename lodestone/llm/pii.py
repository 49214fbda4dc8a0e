"""Personal data by patterns and a semi-Markov conditional random field.

Fixed patterns give the base spans, which always stay. Around what digits and at-signs
are left, a semi-Markov model chooses boundaries and kinds together: up to ``LONGEST``
neighbouring tokens with a digit or at-sign are a candidate segment with features of the
whole segment, and dynamic programming over segment ends finds the best segmentation of
all tokens, however many stand side by side. Weights maximise the
likelihood of base spans in a bounded sample of texts, some of them rewritten (other
separators, no plus) so that the model learns shapes the patterns miss.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import quoted

# Kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+((?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: what every base span holds, for Spark: texts without it have none
MAYBE = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){12}|\+[0-9][ ().0-9-]{7,}[0-9]"
ANCHOR = re.compile(r"[0-9@]")
#: a token; two tokens belong to one region if at most GAP characters part them
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
LONGEST, GAP = 10, 1
#: segment ends that are scored at a time
ENDS = 1000
#: training: texts at most, steps, rate
SAMPLE_ROWS, STEPS, RATE = 240, 6, 0.2
#: features of a span at most
WIDEST = 12


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping: from each at-sign back to the start of its local part."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            low = found.end()
        else:
            low = max(low, at + 1)
        at = text.find("@", low)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns by kind; matches that fail a check are dropped."""
    if not ANCHOR.search(text):
        return {k: [] for k in KINDS}
    digits = [(m, re.sub(r"\D", "", m.group())) for m in CARD.finditer(text)]
    calls = [(m, sum(c in "0123456789" for c in m.group())) for m in PHONE.finditer(text)] if "+" in text else []
    return {
        "email": emails(text) if "@" in text else [],
        "ip": [m.span() for m in IP.finditer(text) if m.group(1)
               and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))] if "." in text else [],
        "card": [m.span() for m, d in digits if 13 <= len(d) <= 19 and luhn(d)],
        "phone": [m.span() for m, n in calls if 9 <= n <= 15],
    }


def regions(text: str, taken: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Whole tokens outside ``taken`` spans, cut only where no candidate segment can cross.

    Tokens further than ``LONGEST`` from every digit and at-sign are in no candidate.
    """
    out: list[list[tuple[int, int]]] = []
    spans, p, covered = sorted(taken), 0, -1
    run: list[tuple[int, int]] = []  # neighbouring free tokens
    low = high = 0  # of the open region in the run: its first token, and the end of its reach

    def close() -> None:
        if high:
            out.append(run[low:high])

    for m in TOKEN.finditer(text):
        s, e = m.span()
        while p < len(spans) and spans[p][0] < e:
            covered = max(covered, spans[p][1])
            p += 1
        free = covered <= s
        if not free or (run and s - run[-1][1] > GAP):
            close()
            run, low, high = [], 0, 0
        if not free:
            continue
        run.append((s, e))
        if "0" <= text[s] <= "9" or text[s] == "@":
            first = max(0, len(run) - LONGEST)
            if high and first >= high:
                close()
                run, low, high = run[first:], 0, 0
            elif not high:
                low = first
            high = len(run) + LONGEST - 1
    close()
    return out


def features(text: str, start: int, end: int, tokens: int) -> list[str]:
    """What a whole span looks like."""
    span = text[start:end]
    runs = [len(r) for r in re.findall(r"[0-9]+", span)]
    digits = "".join(re.findall(r"[0-9]", span))
    seps = "".join(sorted(set(re.sub(r"[^\W_]", "", span))))[:6]
    alpha = bool(re.search(r"[^\W\d_]", span))
    n = len(digits)
    out = ["bias", f"runs={'-'.join(map(str, runs[:6]))}", f"seps={seps}|{alpha}", f"n={min(n, 20)}|{alpha}",
           f"first={'d' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}",
           f"last={'d' if span[-1].isdigit() else 'a' if span[-1].isalpha() else span[-1]}", f"tokens={min(tokens, LONGEST)}"]
    if "@" in span:
        left, _, right = span.partition("@")
        out.append(f"at={bool(left)}|{right.count('.') > 0}|{bool(re.fullmatch(r'[A-Za-z0-9.-]+', right))}|{' ' in span}")
    if 13 <= n <= 19 and not alpha:
        out.append(f"luhn={luhn(digits)}")
    if len(runs) == 4 and not alpha:
        out.append(f"octets={all(int(r) <= 255 for r in re.findall('[0-9]+', span))}|{seps}")
    before, after = text[start - 1:start], text[end:end + 1]
    out.append(f"edge={'x' if before.isalnum() else before.strip() and 'p'}|{'x' if after.isalnum() else after.strip() and 'p'}")
    return out


def segments(text: str, tokens: list[tuple[int, int]], low: int = 0, high: int | None = None) -> dict[tuple[int, int], list[str]]:
    """Candidate segments of a region by token bounds, with a digit or at-sign in each.

    Only those that end after ``low`` tokens and at ``high`` at most.
    """
    out = {}
    high = len(tokens) if high is None else min(high, len(tokens))
    for i in range(max(0, low + 1 - LONGEST), high):
        for j in range(max(i, low) + 1, min(i + LONGEST, high) + 1):
            s, e = tokens[i][0], tokens[j - 1][1]
            if ANCHOR.search(text, s, e):
                out[i, j] = features(text, s, e, j - i)
    return out


class Weights:
    """A weight per feature and kind; features that training didn't see weigh nothing."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.table = np.zeros((1, len(KINDS)))

    def codes(self, cands: dict, learn: bool = False) -> np.ndarray:
        out = np.zeros((len(cands), WIDEST), np.int64)
        for row, fs in enumerate(cands.values()):
            for k, f in enumerate(fs):
                out[row, k] = self.place.setdefault(f, len(self.place) + 1) if learn else self.place.get(f, 0)
        return out

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.table[codes].sum(1)


class Viterbi:
    """Best segmentations over segment ends; a token outside all segments scores 0."""

    def __init__(self):
        self.best, self.back = [0.0], [None]

    def extend(self, n: int, bounds: list[tuple[int, int]], scored: np.ndarray) -> None:
        """On to ``n`` tokens, given all candidates that end behind the tokens so far."""
        by_end: dict[int, list] = {}
        if bounds:
            for (i, j), k, s in zip(bounds, scored.argmax(1).tolist(), scored.max(1).tolist()):
                by_end.setdefault(j, []).append((i, k, s))
        for j in range(len(self.best), n + 1):
            top, back = self.best[j - 1], None
            for i, k, s in by_end.get(j, ()):
                if self.best[i] + s > top:
                    top, back = self.best[i] + s, (i, k)
            self.best.append(top)
            self.back.append(back)

    def path(self) -> list[tuple[int, int, int]]:
        out, j = [], len(self.back) - 1
        while j:
            if self.back[j] is None:
                j -= 1
            else:
                out.append((self.back[j][0], j, self.back[j][1]))
                j = self.back[j][0]
        return out[::-1]


def best_segments(n: int, bounds: list[tuple[int, int]], scored: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation of ``n`` tokens."""
    found = Viterbi()
    found.extend(n, bounds, scored)
    return found.path()


def _add_logs(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def expectations(n: int, bounds: list[tuple[int, int]], scored: np.ndarray) -> np.ndarray:
    """How likely each segment and kind is, by forward and backward sums over segmentations."""
    top = scored.max(1, keepdims=True)
    whole = (top[:, 0] + np.log(np.exp(scored - top).sum(1))).tolist()
    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for (i, j), s in zip(bounds, whole):
        by_end.setdefault(j, []).append((i, s))
        by_start.setdefault(i, []).append((j, s))
    fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        fwd[j] = _add_logs([fwd[j - 1]] + [fwd[i] + s for i, s in by_end.get(j, ())])
    for i in range(n - 1, -1, -1):
        bwd[i] = _add_logs([bwd[i + 1]] + [bwd[j] + s for j, s in by_start.get(i, ())])
    at = np.array([fwd[i] + bwd[j] - fwd[n] for i, j in bounds])
    return np.exp(np.minimum(scored + at[:, None], 0))


def _rewritten(text: str, kind: str) -> list[str]:
    """A found span as written elsewhere, in shapes that the base patterns don't cover."""
    if kind == "phone":
        return [re.sub(r"^\+[0-9]+[\x20.-]*", "", text), re.sub(r"^\+", "00", text)]
    if kind == "card":
        d = re.sub(r"\D", "", text)
        return [".".join(d[i:i + 4] for i in range(0, len(d), 4)), "/".join(d[i:i + 4] for i in range(0, len(d), 4))]
    if kind == "email":
        return [text.replace("@", " @ "), text.replace("@", "(@)")]
    return [text.replace(".", " . ")]


def fit(texts: list[str]) -> Weights:
    """Weights by gradient ascent on the likelihood of the gold segmentations."""
    out, examples = Weights(), []

    def learn(text: str, gold: dict[tuple[int, int], int]) -> None:
        for tokens in regions(text, []):
            cands = segments(text, tokens)
            if cands:
                right = np.zeros((len(cands), len(KINDS)))
                for row, (i, j) in enumerate(cands):
                    if (bounds := (tokens[i][0], tokens[j - 1][1])) in gold:
                        right[row, gold[bounds]] = 1
                examples.append((len(tokens), list(cands), out.codes(cands, learn=True), right))

    for text in texts:
        found = base_spans(text)
        spans = sorted((s, e, KINDS.index(k)) for k in KINDS for s, e in found[k])
        learn(text, {(s, e): k for s, e, k in spans})
        for s, e, k in spans:
            left, right = text[max(0, s - 30):s], text[e:e + 30]
            for new in _rewritten(text[s:e], KINDS[k]):
                learn(left + new + right, {(len(left), len(left) + len(new)): k})
    out.table = np.zeros((len(out.place) + 1, len(KINDS)))
    squares = np.full_like(out.table, 1e-2)
    for _ in range(STEPS):
        for n, bounds, codes, right in examples:
            grad = right - expectations(n, bounds, out.scores(codes))
            touched, place = np.unique(codes, return_inverse=True)
            sums = np.zeros((len(touched), len(KINDS)))
            np.add.at(sums, place.reshape(-1), np.repeat(grad, WIDEST, axis=0))
            squares[touched] += sums * sums
            out.table[touched] += RATE * sums / np.sqrt(squares[touched])
            out.table[0] = 0
    return out


def find_spans(text: str, weights: Weights) -> tuple[list, list]:
    """Base spans and all spans, as ``(kind number, start, end)`` in order."""
    found = base_spans(text)
    base = [(KINDS.index(k), s, e) for k in KINDS for s, e in sorted(found[k])]
    more = []
    if weights.place and ANCHOR.search(text):
        for tokens in regions(text, [(s, e) for _, s, e in base]):
            best = Viterbi()
            for low in range(0, len(tokens), ENDS):
                cands = segments(text, tokens, low, low + ENDS)
                best.extend(min(low + ENDS, len(tokens)), list(cands), weights.scores(weights.codes(cands)))
            more += [(k, tokens[i][0], tokens[j - 1][1]) for i, j, k in best.path()]
    return base, sorted(base + more)


def detect(docs: DataFrame, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and digest are of the base spans; ``spans`` lists those and the model's, as
    ``kind:start:end`` by kind, then start, in code points with the end exclusive. A
    model span never touches a base span. Null and empty texts have none; equal texts
    have equal answers; repeated rows are answered each; an empty table gives no rows;
    extra columns are not read. The model is trained on at most ``sample_rows`` texts
    with a base span, chosen by hash, of which long ones give 4000 characters around
    what may be the first; every text is searched whole.
    """
    key, content = quoted([id, text])
    rows = docs.select(key.alias("doc_id"), F.coalesce(content, F.lit("")).alias("text"))
    at = F.regexp_instr("text", F.lit(MAYBE))

    def with_spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[any(base_spans(t).values()) for t in frame["t"]]]

    maybe = rows.where(F.col("text").rlike(MAYBE)) \
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", F.substr("text", F.greatest(F.lit(1), at - 200), F.lit(4000)).alias("t"))
    sample = maybe.mapInPandas(with_spans, maybe.schema).orderBy("h", "doc_id", "t").limit(sample_rows).collect()
    weights = fit([r["t"] for r in sample])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        join = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
        for frame in frames:
            found = [find_spans(t, own) for t in frame["text"]]
            out = frame[["doc_id"]].copy()
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(x[0] == k for x in b) for b, _ in found]
            out["base_sha256"] = [hashlib.sha256(join(b).encode()).hexdigest() for b, _ in found]
            out["spans"] = [join(s) for _, s in found]
            yield out

    id_type = docs.schema[id].dataType.simpleString()
    return rows.mapInPandas(answer, f"doc_id {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                            "base_sha256 string, spans string")
