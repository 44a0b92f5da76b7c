"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole segments of a zone (a run of characters that personal
data is made of): features see the entire candidate, not single tokens.  A
dynamic program over segments of bounded length chooses boundaries and kinds
together.  Weights are learnt from the zones of a bounded sample of documents,
with the exact patterns' finds, and other spellings of them, as truth.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import accumulate, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from shoalwise.llm.common import text_bytes

KINDS = ("email", "ip", "card", "phone")
#: Longest entity in tokens.
LONGEST = 24
#: Documents and zones that the field is fitted on at most.
SAMPLE_DOCS, SAMPLE_ZONES = 2000, 300
#: Characters of a document that the fit sees at most, and on each side of an ``@`` or number.
SAMPLE_CHARS, SIDE = 1 << 14, 100
#: Zones of more characters first drop segments without hope, for so many first tokens at a time.
LONG_ZONE, HOPEFUL = 64, 1 << 14
#: How much better than no entity a span must be (log odds).
MARGIN = 2.0

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    """The exact patterns' matches, by kind as listed, then start.

    Written so that each kind reads the text once: an address is looked for
    around each ``@``, and numbers start where digits start, which gives the
    same leftmost matches as the plain patterns.
    """
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


#: A zone: a run of characters of personal data; a single space inside it stands between digits or brackets only.
_ZONE = re.compile(r"(?:[A-Za-z0-9@._%+()/-]|(?<=[0-9)]) (?=[0-9(+])){4,}")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Zones with an ``@`` or at least seven digits."""
    for m in _ZONE.finditer(text):
        if "@" in m[0] or sum(c.isdigit() for c in m[0]) >= 7:
            yield m.span()


def segment_features(text: str, start: int, end: int, whole: bool) -> list[int]:
    """Numbers of the features that a candidate has, seen as a whole."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    on = [0, 1 + min(6, (n > 0) + (n > 3) + (n > 6) + (n > 8) + (n > 12) + (n > 19))]
    letters = any(c.isalpha() for c in s)
    left, right = text[start - 1 : start], text[end : end + 1]
    groups = re.findall("[0-9]+", s)
    lengths = [len(g) for g in groups]
    local, mark, domain = s.partition("@")
    labels = domain.split(".")
    checks = (
        letters,
        s.count("@") == 1,
        bool(mark and local and all(c in _LOCAL_CHARS for c in local)),
        bool(mark and len(labels) > 1 and all(labels) and labels[-1].isalpha() and all(c.isalnum() or c in "-." for c in domain)),
        s.startswith("+"),
        lengths[-3:] == [3, 3, 4],
        lengths[-2:] == [3, 4],
        len(groups) == 4 and set(s) <= set("0123456789."),
        len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        12 < n < 20 and luhn(digits),
        12 < n < 20 and not luhn(digits),
        not letters and len(set(re.sub("[0-9]", "", s))) <= 1,
        len(lengths) > 3 and set(lengths[:-1]) == {4},
        bool(left) and (left.isalnum() or left in "@._%+-/"),
        bool(right) and (right.isalnum() or right in "@_%+/-"),
        s[-1:].isalnum(),
        s[:1].isalnum() or s[:1] in "+(",
        s.count("(") == s.count(")"),
        "/" in s,
        whole,
    )
    return on + [8 + i for i, c in enumerate(checks) if c]


N_FEATURES = 8 + 20


def candidates(text: str, start: int, end: int, longest: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of tokens of a zone, and (first token, end token, start, end) of its segments."""
    cuts = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
    n = len(cuts) - 1
    out = []
    for i in range(n):
        if text[cuts[i]] in " .)-/%@_":
            continue
        for j in range(i + 1, min(n, i + longest) + 1):
            if text[cuts[j] - 1].isalnum() and cuts[j] - cuts[i] >= 6:
                out.append((i, j, cuts[i], cuts[j]))
    return n, out


@dataclass
class Field:
    """Weights by kind and feature; all zero for a field that nothing was learnt from."""

    weights: np.ndarray
    longest: int = LONGEST

    def hopeful(self, text: str, start: int, end: int, margin: float) -> tuple[int, list[tuple[int, int, int, int]]]:
        """Like :func:`candidates`, without the segments that cannot score over 0.

        Counts of digits, letters and ``@`` give some features of a segment and
        rule out others; the weights of the rest enter where they are positive.
        Segments of long zones then cost array steps only, most of them.
        """
        cuts = np.array([start, *(m.end() for m in _TOKEN.finditer(text, start, end))])
        n = len(cuts) - 1
        codes = np.frombuffer(text[start:end].encode("utf-32-le", errors="replace"), np.uint32)
        digit = (codes >= 48) & (codes <= 57)
        letter = (codes | 32 >= 97) & (codes | 32 <= 122)
        counts = [np.concatenate([[0], np.cumsum(c)])[cuts - start] for c in (digit, letter, codes == 64)]
        first = codes[cuts[:-1] - start]
        opens = np.isin(first, [ord(c) for c in " .)-/%@_"], invert=True)
        plain_start = (digit | letter)[cuts[:-1] - start] | (first == 43) | (first == 40)
        closes = (digit | letter)[cuts[1:] - start - 1]
        w = self.weights.T
        up = np.maximum(w, 0)
        sure = w[0] + w[23] + up[[21, 22, 25, 26, 27]].sum(axis=0) - margin
        out = []
        for a in range(0, n, HOPEFUL):
            i = np.arange(a, min(n, a + HOPEFUL))
            i = i[opens[i]]
            i, j = (x.ravel() for x in np.broadcast_arrays(i[:, None], i[:, None] + np.arange(1, self.longest + 1)))
            keep = j <= n
            i, j = i[keep], j[keep]
            keep = closes[j - 1] & (cuts[j] - cuts[i] >= 6)
            i, j = i[keep], j[keep]
            digits, letters, ats = (c[j] - c[i] for c in counts)
            bucket = 1 + np.minimum(6, sum((digits > k).astype(int) for k in (0, 3, 6, 8, 12, 19)))
            most = sure + w[bucket]
            for holds, on in (
                (letters > 0, w[8]),
                (ats == 1, w[9]),
                (ats > 0, up[10] + up[11]),
                (first[i] == 43, w[12]),
                (plain_start[i], w[24]),
                (digits >= 7, up[13] + up[14]),
                ((digits >= 4) & (letters == 0), up[15]),
                (digits >= 4, up[16]),
                ((digits > 12) & (digits < 20), np.maximum(w[17], w[18])),
                (letters == 0, up[19]),
                (digits >= 4, up[20]),
            ):
                most = most + holds[:, None] * on
            keep = (most > -1e-6).any(axis=1)
            i, j = i[keep], j[keep]
            out += zip(i.tolist(), j.tolist(), cuts[i].tolist(), cuts[j].tolist(), strict=True)
        return n, out

    def spans(self, text: str, start: int, end: int, margin: float = MARGIN) -> list[Span]:
        """Best segmentation of one zone: Viterbi over its segments."""
        n, segments = self.hopeful(text, start, end, margin) if end - start > LONG_ZONE else candidates(text, start, end, self.longest)
        by_end: dict[int, list] = {}
        for i, j, a, b in segments:
            on = segment_features(text, a, b, a == start and b == end)
            scores = self.weights[:, on].sum(axis=1) - margin
            kind = int(np.argmax(scores))
            if scores[kind] > 0:
                by_end.setdefault(j, []).append((i, float(scores[kind]), kind, a, b))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for step in by_end.get(j, ()):
                if best[step[0]] + step[1] > best[j]:
                    best[j], back[j] = best[step[0]] + step[1], step
        out: list[Span] = []
        j = n
        while j > 0:
            step = back[j]
            if step is None:
                j -= 1
            else:
                out.append((KINDS[step[2]], step[3], step[4]))
                j = step[0]
        return out[::-1]


def other_spellings(kind: str, text: str) -> list[str]:
    """The same entity as people also write it, and things that look like it and are none."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "phone":
        return [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"]
    if kind == "card":
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return []


def look_alikes(kind: str, text: str) -> list[str]:
    if kind == "ip":
        return [text.replace(".", "-"), f"{text}.{text}", "3" + text.replace(".", "00.", 1)]
    if kind == "card":
        digits = re.sub("[^0-9]", "", text)
        return [digits[:-1] + str((int(digits[-1]) + 1) % 10), digits + digits, f"2024-{digits[:2]}-{digits[2:4]} {digits[4:6]}.{digits[6:8]}"]
    if kind == "email":
        return [text.replace("@", "@@"), text.partition("@")[2], text.partition("@")[0] + "@"]
    if kind == "phone":
        digits = re.sub("[^0-9]", "", text)
        return [digits[:8], f"{digits[:4]}/{digits[4:8]}/{digits[-4:]}"]
    return []


def drawn(texts: list[str], most: int) -> list[tuple[str, int, int, list[Span]]]:
    """At most ``most`` different zones of all documents, as (text around, zone start, zone end, true spans).

    Zones are ordered by a hash, each document's first ones before any second
    ones, so that no document fills the draw while others have zones left.
    Each kind, and zones without any, has an equal share by that order; what
    the shares leave over goes to the other zones by the same order.
    """
    pool: list[tuple[int, bytes, tuple[str, int, int, list[Span]]]] = []
    seen: set[str] = set()
    for text in texts:
        known = sorted(base_spans(text), key=lambda s: (s[1], s[1] - s[2]))
        here, first = [], 0
        for a, b in zones(text):
            while first < len(known) and known[first][1] < a:
                first += 1
            # where an exact pattern ran on over several entities, it tells nothing
            if text[a:b] in seen or any(len(re.sub("[^0-9]", "", m[0])) > 19 and " " in m[0] for p in (_CARD, _PHONE) for m in p.finditer(text, a, b)):
                continue
            seen.add(text[a:b])
            true: list[Span] = []
            for span in takewhile(lambda s: s[1] < b, known[first:]):  # noqa: B023
                if span[2] <= b and (not true or span[1] >= true[-1][2]):
                    true.append(span)
            c = max(0, a - 20)
            here.append((blake2b(text[a:b].encode(errors="replace")).digest(), (text[c : b + 20], a - c, b - c, [(k, s - c, e - c) for k, s, e in true])))
        here.sort(key=lambda z: z[0])
        pool += [(turn, *z) for turn, z in enumerate(here)]
    pool.sort(key=lambda z: z[:2])
    share, chosen = max(1, most // (len(KINDS) + 1)), set()
    for kind in (*KINDS, None):
        of_kind = [i for i, (*_, z) in enumerate(pool) if (any(k == kind for k, *_ in z[3]) if kind else not z[3])]
        chosen.update(of_kind[:share])
    others = [i for i in range(len(pool)) if i not in chosen]
    chosen = sorted([*chosen, *others[: max(0, most - len(chosen))]])
    return [pool[i][2] for i in chosen[:most]]


def examples(texts: list[str], most: int) -> list[tuple[str, int, int, list[Span]]]:
    """(text, zone start, zone end, true spans) drawn from all documents, then from spellings of what those hold."""
    out = drawn(texts, most)
    extra: list[tuple[str, list[Span]]] = []
    alone: list[tuple[str, str]] = []
    for text, _, _, true in out:
        if true:
            kind, s, e = true[0]
            alone.append((kind, text[s:e]))
        for kind, s, e in true:
            extra += [(x, [(kind, 0, len(x))]) for x in other_spellings(kind, text[s:e])]
            extra += [(x, []) for x in look_alikes(kind, text[s:e])]
    for (one, a), (two, b) in zip(alone, alone[1:], strict=False):
        extra.append((f"{a} {b}", [(one, 0, len(a)), (two, len(a) + 1, len(a) + 1 + len(b))]))
    shown = [(x, 0, len(x), true) for x, true in extra if len(x) >= 4]
    n = min(most, len(shown))
    return out + [shown[i * len(shown) // n] for i in range(n)]


def fit(texts: list[str], most: int = SAMPLE_ZONES, longest: int = LONGEST, epochs: int = 40, rate: float = 0.15) -> Field:
    """Maximise the conditional likelihood of the true segmentations; forward and backward sums per zone."""
    data = []
    for text, start, end, true in examples(texts, most):
        n, segments = candidates(text, start, end, longest)
        if not segments:
            continue
        matrix = np.zeros((len(segments), N_FEATURES))
        gold = np.zeros((len(segments), len(KINDS)))
        for r, (_, _, a, b) in enumerate(segments):
            matrix[r, segment_features(text, a, b, a == start and b == end)] = 1
            for kind, s, e in true:
                if (s, e) == (a, b):
                    gold[r, KINDS.index(kind)] = 1
        data.append((n, [(i, j) for i, j, _, _ in segments], matrix, gold))
    weights = np.zeros((len(KINDS), N_FEATURES))
    if not any(g.any() for *_, g in data):
        return Field(weights, longest)
    weights[:, 0] = -2
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, epochs + 1):
        grad = 0.01 * weights
        for n, ends, matrix, gold in data:
            scores = matrix @ weights.T
            total = np.logaddexp.reduce(scores, axis=1)
            forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            forward[0] = backward[n] = 0
            into: list[list[int]] = [[] for _ in range(n + 1)]
            out_of: list[list[int]] = [[] for _ in range(n + 1)]
            for r, (i, j) in enumerate(ends):
                into[j].append(r)
                out_of[i].append(r)
            starts = np.array([i for i, _ in ends])
            stops = np.array([j for _, j in ends])
            for j in range(1, n + 1):
                steps = [forward[j - 1]]
                if into[j]:
                    steps.extend(forward[starts[into[j]]] + total[into[j]])
                forward[j] = np.logaddexp.reduce(steps)
            for i in range(n - 1, -1, -1):
                steps = [backward[i + 1]]
                if out_of[i]:
                    steps.extend(backward[stops[out_of[i]]] + total[out_of[i]])
                backward[i] = np.logaddexp.reduce(steps)
            seen = np.exp(forward[starts] + backward[stops] - forward[n])[:, None] * np.exp(scores)
            grad += (seen - gold).T @ matrix / len(data) * 10
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        weights = weights - rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Field(weights, longest)


_ANCHOR = re.compile("@|[0-9][0-9 ().-]{6}")


def around(text: str, most: int = SAMPLE_CHARS, side: int = SIDE) -> str:
    """A line for each stretch around an ``@`` or a long number: two words and at most ``side`` characters each way.

    Stretches that meet are one, up to ``4 * side`` characters.  Of more than
    ``most`` characters together those of the lowest hashes stay, in their order.
    """
    spans: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        left, right = text[max(0, m.start() - side) : m.start()], text[m.end() : m.end() + side]
        a = m.start() - len(" ".join(re.split(r"\s", left)[-2:]))
        b = m.end() + len(" ".join(re.split(r"\s", right)[:2]))
        if spans and a <= spans[-1][1]:
            a = spans[-1][1]
            if b - spans[-1][0] <= 4 * side:
                spans[-1][1] = b = max(a, b)
                continue
        if a < b:
            spans.append([a, b])
    held = [(blake2b(text[a:b].encode(errors="replace"), digest_size=8).digest(), a, b) for a, b in spans]
    kept, size = [], 0
    for _, a, b in sorted(held):
        if (size := size + b - a) > most:
            break
        kept.append((a, b))
    return "\n".join(text[a:b] for a, b in sorted(kept))


@pandas_udf(T.StringType())
def _around(texts: pd.Series) -> pd.Series:
    return texts.map(around)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", most_docs: int = SAMPLE_DOCS, **options) -> Field:
    """Fit on at most ``most_docs`` different documents with an ``@`` or a long number, chosen by a hash of the text.

    Of each at most ``SAMPLE_CHARS`` characters around such places reach the
    driver.  NULL and empty texts are no examples, repeated texts are one; with
    no example at all the field's weights are 0 and it adds no spans.
    """
    likely = docs.where(F.col(text).rlike("@|[0-9][0-9 ().-]{6}")).select(F.col(text).cast("string").alias("t"))
    hashed = likely.select(F.xxhash64("t").alias("h"), "t")
    # copies become one hash within each task, before anything is dealt or counted
    lowest = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(most_docs).collect()]
    chosen = hashed.where(F.col("h") <= (lowest[-1] if lowest else None))
    rows = chosen.dropDuplicates(["h"]).select("h", _around("t").alias("t")).collect()
    return fit([r["t"] for r in sorted(rows, key=lambda r: r["h"])], **options)


_LIKELY = re.compile(rb"[0-9@]")


def spans_of(text: bytes, field: Field, margin: float = MARGIN) -> list[tuple[str, int, int, bool]]:
    """All spans by kind as listed, then start; the field's own never meet a base span."""
    if not _LIKELY.search(text):
        return []
    plain = text.decode(errors="replace")
    base = base_spans(plain)
    found = [(*s, True) for s in base]
    if field.weights.any():
        taken = sorted((a, b) for _, a, b in base)
        ends = list(accumulate((e for _, e in taken), max))
        for a, b in zones(plain):
            at = a
            meets = taken[bisect_right(ends, a) : bisect_left(taken, (b,))]
            for s, e in [x for x in meets if x[1] > a] + [(b, b)]:
                if s - at >= 6:
                    found += [(*x, False) for x in field.spans(plain, at, s, margin)]
                at = max(at, e)
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_private(text: str | Column, field: Field, margin: float = MARGIN) -> Column:
    """Array of (kind, start, end, base) over a whole text, in code points, end exclusive.

    NULL and empty texts have none; each row is read by itself, so repeated
    rows give equal results.
    """
    weights, longest = field.weights, field.longest

    @pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        here = Field(weights, longest)
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans_of(bytes(t), here, margin)] for t in batch]
            yield pd.Series(rows, dtype=object)

    return find.asNondeterministic()(text_bytes(text))


def redacted(text: str | Column, field: Field, margin: float = MARGIN) -> Column:
    """The text with each personal datum replaced by its kind, as in ``[email]``; spans that meet are one. NULL stays NULL."""
    column = F.col(text) if isinstance(text, str) else text
    weights, longest = field.weights, field.longest

    def replace(text: bytes, here: Field) -> str | None:
        spans = sorted(spans_of(text, here, margin), key=lambda s: (s[1], -s[2]))
        if not spans:
            return None
        plain, out, at = text.decode(errors="replace"), [], 0
        for kind, a, b, _ in spans:
            if a >= at:
                out += [plain[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, plain[at:]])

    @pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        here = Field(weights, longest)
        for batch in batches:
            yield pd.Series([replace(bytes(t), here) for t in batch], dtype=object)

    # only changed texts come back from Python
    return F.coalesce(redact.asNondeterministic()(text_bytes(column)), column.cast("string"))
