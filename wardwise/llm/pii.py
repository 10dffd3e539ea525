"""Personal data: fixed patterns, and a semi-Markov random field for the rest.

The patterns give the base spans. Around everything that looks like a number of
seven digits or more, or holds an at sign, a region is cut into tokens, and a
semi-Markov conditional random field chooses segments and their types jointly:
each candidate segment is scored as a whole (digits, groups, signs, check digit,
borders, the word before), and dynamic programming over segments of at most
``LONGEST`` tokens finds the best labelling of the whole region, however long it
is. Segments of a kind that touch no base span and beat "nothing" by as much as
nearly all training spans do are added.

The field is trained on a bounded sample of regions (``REGIONS`` of at most
``WIDEST`` characters, chosen by a hash of their text) by gradient steps on the log
likelihood. Labels are the base spans; so that the field learns more than the
patterns, every region with a span counts once more with the span rewritten
(``rewritten``): telephone numbers without their plus sign, cards in dotted groups.
Finding spans is one narrow pass over whole texts.

Offsets count code points; ends are exclusive. Null texts are empty: no spans.
Repeated rows give repeated rows; an empty table gives no rows, and a corpus
without a region no added spans. ``spans`` replaces a given column of that name;
all other columns are kept as they are, and ``redact`` changes the text alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from wardwise.llm.common import per_batch

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+")  # shorter chains never count, and chains do not touch
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

NUMBER = re.compile(r"[0-9](?:[ .()-]{0,3}[0-9]){6,}+")
AROUND = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-()@")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
REGIONS, EPOCHS, LONGEST, REACH, WIDEST = 800, 6, 16, 64, 512
SHARE = 256  # tokens whose segments are scored at a time
ADDED_QUANTILE = 0.05

Span = tuple[str, int, int]
SPANS = ArrayType(
    StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("base", "boolean")
)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (2 * d - 9 if d > 4 else 2 * d) if i % 2 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """The part before each at sign, back to the last match, and a domain after it."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        after = DOMAIN.match(text, at + 1) if start < at else None
        if after:
            end = after.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind as listed."""
    found = emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def regions(text: str) -> list[tuple[int, int]]:
    """What the field looks at: numbers and at signs, with up to ``REACH`` characters that adjoin them."""
    found = [(m.start(), m.end()) for m in NUMBER.finditer(text)]
    at = text.find("@")
    while at >= 0:
        found.append((at, at + 1))
        at = text.find("@", at + 1)
    grown = []
    for a, b in sorted(found):
        stop = max(0, a - REACH)
        while a > stop and text[a - 1] in AROUND:
            a -= 1
        stop = min(len(text), b + REACH)
        while b < stop and text[b] in AROUND:
            b += 1
        if grown and a <= grown[-1][1]:
            grown[-1] = (grown[-1][0], max(b, grown[-1][1]))
        else:
            grown.append((a, b))
    return grown


FEATURES = 46


def features(tokens: list[str], i: int, j: int, before: str, after: str) -> list[int]:
    """Indices of the whole-span features that hold for ``tokens[i:j]``."""
    segment = "".join(tokens[i:j])
    digits = sum(len(t) for t in tokens[i:j] if "0" <= t[0] <= "9")
    groups = [len(t) for t in tokens[i:j] if "0" <= t[0] <= "9"]
    letters = sum(len(t) for t in tokens[i:j] if t[0].isascii() and t[0].isalpha())
    dots, signs = segment.count("."), segment.count("@")
    left = tokens[i - 1][-1] if i else before[-1:]
    right = tokens[j][0] if j < len(tokens) else after
    found = [
        0 if digits == 0 else 1 if digits < 7 else 2 if digits < 10 else 3 if digits < 13 else 4 if digits < 14
        else 5 if digits < 17 else 6 if digits < 20 else 7,
        8 + min(len(groups), 6),
        15 + min(dots, 4),
        20 + min(signs, 2),
        23 if segment[0] == "+" else 24,
        25 if "(" in segment and ")" in segment else 26 if "(" in segment or ")" in segment else 27,
        28 if letters else 29,
        30 if left.isalnum() else 31 if left in "+-.(@" and left else 32,
        33 if right.isalnum() else 34 if right in "-)@" and right else 35,
        36 if segment[0].isspace() or segment[-1].isspace() else 37,
        38 if groups and max(groups) <= 3 else 39,
    ]
    if signs == 1:
        local, _, domain = segment.partition("@")
        found.append(40 if local and "." in domain.strip(".") and segment[-1].isalnum() else 41)
    if i == 0 and before.rstrip("=: ").lower().endswith(("tel", "phone", "call", "fax", "mail", "card", "ip")):
        found.append(42)
    if not segment[-1].isalnum():
        found.append(43)
    if 14 <= digits <= 19:
        found.append(44 if luhn(_digits(segment)) else 45)
    return found


@dataclass
class Lattice:
    """A region's tokens and candidate segments."""

    starts: list[int]  # of each token in the text, and the end
    segments: list[tuple[int, int]]
    matrix: np.ndarray


def _candidates(tokens: list[str], firsts: range, before: str, after: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The segments that start at ``firsts``, and their features."""
    segments, matrix = [], []
    for i in firsts:
        if tokens[i].isspace():
            continue
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            if tokens[j - 1].isspace():
                continue
            row = np.zeros(FEATURES, "f4")
            row[features(tokens, i, j, before, after)] = 1
            segments.append((i, j))
            matrix.append(row)
    return segments, np.array(matrix, "f4").reshape(-1, FEATURES)


def _cut(text: str, a: int, b: int) -> tuple[list[str], list[int], str, str]:
    """A region's tokens, where they start, and what stands before and after it."""
    tokens, starts = TOKEN.findall(text, a, b), [a]
    for t in tokens:
        starts.append(starts[-1] + len(t))
    return tokens, starts, text[max(0, a - 12) : a], text[b : b + 1]


def lattice(text: str, a: int, b: int) -> Lattice:
    tokens, starts, before, after = _cut(text, a, b)
    return Lattice(starts, *_candidates(tokens, range(len(tokens)), before, after))


def _best(n: int, scored: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The best choice of segments (first, end, kind, score) that do not overlap among ``n`` tokens."""
    ending: dict[int, list[int]] = {}
    for s, (_, j, _, _) in enumerate(scored):
        ending.setdefault(j, []).append(s)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for s in ending.get(j, ()):
            value = best[scored[s][0]] + scored[s][3]
            if value > best[j]:
                best[j], back[j] = value, s
    chosen, j = [], n
    while j:
        s = back[j]
        if s < 0:
            j -= 1
        else:
            chosen.append(scored[s])
            j = scored[s][0]
    return chosen[::-1]


def _above(segments: list[tuple[int, int]], matrix: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Segments that beat "nothing", with their best kind and its score."""
    scores = matrix @ weights
    tops = scores.max(1, initial=-np.inf)
    return [(*segments[s], int(scores[s].argmax()), float(tops[s])) for s in np.flatnonzero(tops > 0)]


def best_labels(lat: Lattice, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The best labelling: (first token, end token, kind, score); tokens outside score 0.

    Segments are scored in the shares of ``labelled``: a product rounds by the number of its rows.
    """
    share = np.array([i for i, _ in lat.segments], "i8") // SHARE
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(share)]
    scored = [s for a, b in zip(cuts, cuts[1:]) for s in _above(lat.segments[a:b], lat.matrix[a:b], weights)]
    return _best(len(lat.starts) - 1, scored)


def labelled(text: str, a: int, b: int, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """The best labelling of a region of any length: (start, end, kind, score) in the text.

    Features are held for ``SHARE`` tokens at a time; the choice is made over the whole region.
    """
    tokens, starts, before, after = _cut(text, a, b)
    scored = []
    for at in range(0, len(tokens), SHARE):
        scored += _above(*_candidates(tokens, range(at, min(at + SHARE, len(tokens))), before, after), weights)
    return [(starts[i], starts[j], kind, value) for i, j, kind, value in _best(len(tokens), scored)]


def gradient(lat: Lattice, gold: list[tuple[int, int]], weights: np.ndarray) -> np.ndarray:
    """Of the log likelihood: features of the gold segments less the expected ones."""
    n = len(lat.starts) - 1
    scores = (lat.matrix @ weights).astype("f8")
    top = scores.max(1)
    joint = top + np.log(np.exp(scores - top[:, None]).sum(1))  # over the kinds
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(lat.segments):
        ending[j].append(s)
        starting[i].append(s)
    for j in range(1, n + 1):
        terms = [forward[j - 1], *(forward[lat.segments[s][0]] + joint[s] for s in ending[j])]
        forward[j] = np.logaddexp.reduce(terms)
    for i in range(n - 1, -1, -1):
        terms = [backward[i + 1], *(backward[lat.segments[s][1]] + joint[s] for s in starting[i])]
        backward[i] = np.logaddexp.reduce(terms)
    i, j = (np.array(x) for x in zip(*lat.segments))
    share = np.exp(forward[i][:, None] + scores + backward[j][:, None] - forward[n])
    for s, kind in gold:
        share[s, kind] -= 1
    return -lat.matrix.T @ share


@dataclass(frozen=True)
class Field:
    weights: np.ndarray
    least: tuple[float, ...]  # score, by kind, from which a segment is added


def _apart(base: list[Span]) -> list[Span]:
    """Base spans by start, longer ones first, without those that overlap one before."""
    kept, end = [], 0
    for span in sorted(base, key=lambda s: (s[1], -s[2])):
        if span[1] >= end:
            kept.append(span)
            end = span[2]
    return kept


def rewritten(text: str) -> tuple[str, list[Span]] | None:
    """The text with its telephone numbers and cards written as no pattern has them, and all its spans.

    The plus sign of a telephone number goes, and at every second length the country
    with it; the digits of a card are grouped by four and dotted.
    """
    spans, parts, end, changed = [], [], 0, False
    for kind, a, b in _apart(base_spans(text)):
        parts.append(text[end:a])
        new = text[a:b]
        if kind == "phone":
            new = new[1:]
            if b % 2 and (cut := re.match(r"[0-9]{1,3}[ .-]*(?=\(?[0-9])", new)) and len(_digits(new[cut.end() :])) >= 9:
                new = new[cut.end() :]
        elif kind == "card":
            digits = _digits(new)
            new = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        changed = changed or new != text[a:b]
        start = sum(map(len, parts))
        spans.append((kind, start, start + len(new)))
        parts.append(new)
        end = b
    return ("".join([*parts, text[end:]]), spans) if changed else None


def _example(text: str, spans: list[Span]) -> tuple[Lattice, list[tuple[int, int]]]:
    """The lattice of a whole text, and its spans as (segment, kind)."""
    lat = lattice(text, 0, len(text))
    at = {p: k for k, p in enumerate(lat.starts)}
    index = {s: k for k, s in enumerate(lat.segments)}
    places = [(index.get((at.get(a), at.get(b))), KINDS.index(kind)) for kind, a, b in spans]
    return lat, [(s, kind) for s, kind in places if s is not None]


def train(texts: list[str]) -> Field | None:
    """Fit on regions that stand alone as texts: as they are, and rewritten."""
    examples = []
    for text in texts:
        examples.append(_example(text, _apart(base_spans(text))))
        if other := rewritten(text):
            examples.append(_example(*other))
    examples = [e for e in examples if e[0].segments]
    if not any(gold for _, gold in examples):
        return None
    weights = np.full((FEATURES, len(KINDS)), -0.1)
    sums = np.full_like(weights, 1e-2)
    for _ in range(EPOCHS):
        for lat, gold in examples:
            g = gradient(lat, gold, weights) - 1e-3 * weights
            sums += g * g
            weights += 0.5 * g / np.sqrt(sums)
    least = []
    for kind in range(len(KINDS)):
        seen = [float((lat.matrix[s] @ weights)[kind]) for lat, gold in examples for s, k in gold if k == kind]
        least.append(max(0.0, float(np.quantile(seen, ADDED_QUANTILE))) if seen else float("inf"))
    return Field(weights, tuple(least))


def added_spans(text: str, base: list[Span], field: Field | None) -> list[Span]:
    """What the field adds: segments that touch no base span."""
    found = []
    starts = [a for _, a, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))  # the farthest end so far
    for a, b in regions(text) if field else []:
        for start, end, kind, value in labelled(text, a, b, field.weights):
            before = bisect_left(starts, end)  # base spans that start before the segment's end
            if value >= field.least[kind] and not (before and reach[before - 1] > start):
                found.append((KINDS[kind], start, end))
    return found


def learn(df: DataFrame, column: str = "text", size: int = REGIONS, widest: int = WIDEST) -> Field | None:
    """Train on the ``size`` regions of at most ``widest`` characters with the smallest digests, counted once each."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() or "" for t in batch.column(column)]
        found = sorted({t[max(0, a - 12) : b + 1] for t in texts for a, b in regions(t) if b - a <= widest})
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["region"])

    cuts = df.select(column).mapInArrow(per_batch(cut), "region string")
    rows = cuts.groupBy("region").agg(F.count("*")).orderBy(F.xxhash64("region"), "region").limit(size).collect()
    return train([r.region for r in rows])


def spans(df: DataFrame, field: Field | None, column: str = "text") -> DataFrame:
    """All columns, and ``spans``: an array of (kind, start, end, base)."""
    kept = df.drop("spans")
    schema = StructType([*kept.schema.fields]).add("spans", SPANS)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(column):
            text = text.as_py() or ""
            base = base_spans(text)
            both = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, field)]
            both.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            found.append([dict(zip(("kind", "start", "end", "base"), s)) for s in both])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], schema.names)

    return kept.mapInArrow(per_batch(one), schema)


def redact(df: DataFrame, field: Field | None, column: str = "text") -> DataFrame:
    """Same columns; every span replaced by its kind in angle brackets. Null stays null."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = []
        for text in batch.column(column).to_pylist():
            if text is not None:
                base = base_spans(text)
                parts, end = [], 0
                for kind, a, b in sorted(base + added_spans(text, base, field), key=lambda s: (s[1], -s[2])):
                    if a >= end:
                        parts += [text[end:a], f"<{kind}>"]
                    end = max(end, b)
                text = "".join([*parts, text[end:]]) if parts else text
            clean.append(text)
        at = batch.schema.get_field_index(column)
        return batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return df.mapInArrow(per_batch(one), df.schema)


def digests(df: DataFrame, field: Field | None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts of base spans.

    Spans are written kind:start:end, by start and then kind, joined by commas.
    """
    schema = StructType([df.schema[key]])
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(column):
            text = text.as_py() or ""
            base = base_spans(text)
            more = added_spans(text, base, field)
            both = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base
            written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            rows.append((
                *(sum(k == kind for k, *_ in base) for kind in KINDS),
                hashlib.sha256(written.encode()).hexdigest(),
                ",".join(f"{k}:{a}:{b}" for k, a, b in both), len(more),
            ))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], schema.names)

    return df.select(key, column).mapInArrow(per_batch(one), schema)
