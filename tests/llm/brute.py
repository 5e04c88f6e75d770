"""Plain versions of the operators, written from their contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(*values: bytes | None, seed: int = 42) -> int:
    """64-bit hash of values one after another, nulls skipped; unsigned."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v, seed=seed)
    return seed


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-])+)""", re.IGNORECASE | re.ASCII)


def secret_spans(text: str | None, scope: int) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base spans with linked weak ones, by start, then kind."""
    text = text or ""
    order = ["assign", "access", "hex", "secret", "endpoint"]
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    bare = [("secret", *m.span()) for m in re.finditer("[A-Za-z0-9/+=]+", text) if len(m.group()) == 40 and "=" not in m.group()]
    ends = [("endpoint", *m.span()) for m in re.finditer(r"https?://[A-Za-z0-9.-]+(:[0-9]+)?", text) if len(m.group()) >= 9]
    access = [s for k, s, _ in found if k == "access"]
    secrets = [s for k, s, _ in found + bare if k != "access"]
    near = lambda at, places: any(abs(at - p) <= scope for p in places)
    weak = [x for x in bare if near(x[1], access)] + [x for x in ends if near(x[1], access) and near(x[1], secrets)]
    by_place = lambda x: (x[1], order.index(x[0]))
    return sorted(found, key=by_place), sorted(found + weak, key=by_place)


# fingerprints


def winnowed(text: str, k: int, w: int, place_bits: int) -> list[int]:
    """Entries in the order of their windows: the high bits of a hash, and a place in words."""
    words = WORD.findall(text)
    if not words:
        return []
    hashed = [chained(x.encode()).to_bytes(8, "little") for x in words]
    grams = [chained(*hashed[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [chained(*hashed)]
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        window = range(i, min(i + w, len(grams)))
        best = min(window, key=lambda j: (grams[j] >> 33, -j))
        entry = (grams[best] >> place_bits, best)
        if entry not in out[-1:]:
            out.append(entry)
    return out


def alike(a: list, b: list) -> float:
    x, y = {e[0] for e in a}, {e[0] for e in b}
    return len(x & y) / len(x | y) if x | y else 1.0


# quality


class KneserNey:
    """Modified Kneser-Ney over character 4-grams, with dictionaries; below the unigrams, an equal share for each code point."""

    def __init__(self, trusted: list[str | None]):
        counts: Counter = Counter(g for t in trusted for g in self.grams(t))
        self.orders = []
        for _ in range(4):
            of_context: dict = defaultdict(list)
            for gram, n in counts.items():
                of_context[gram[:-1]].append(n)
            tally = Counter(counts.values())
            self.orders.append((counts, of_context, self.discounts(*(tally[i] for i in (1, 2, 3, 4)))))
            counts = Counter(g[1:] for g in counts)

    @staticmethod
    def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
        if not n1 or not n2:
            return [0, 0.5, 0.5, 0.5]
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
        return [0] + [min(max(d, 0.05), top) for d, top in zip(raw, (0.95, 1.95, 2.95), strict=True)]

    @staticmethod
    def grams(text: str | None) -> list[tuple[int, ...]]:
        line = [0, 0, 0] + [ord(c) for c in text or ""]
        return [tuple(line[i : i + 4]) for i in range(len(line) - 3)]

    def probability(self, gram: tuple[int, ...], order: int = 0) -> float:
        if order == 4:
            return 1 / 0x110000
        counts, of_context, discount = self.orders[order]
        lower = self.probability(gram[1:], order + 1)
        rest = of_context.get(gram[:-1])
        if not rest:
            return lower
        n = counts.get(gram, 0)
        cut = sum(discount[min(x, 3)] for x in rest)
        return (n - discount[min(n, 3)]) / sum(rest) + cut / sum(rest) * lower

    def bits(self, text: str | None) -> float | None:
        each = [-math.log2(self.probability(g)) for g in self.grams(text)]
        return sum(each) / len(each) if each else None


def judged(rows: list[tuple], labels: list[tuple], quality) -> list[tuple[float | None, float | None, float | None]]:
    """(bits, adjusted, threshold) of each row (doc_id, text, lang, ...)."""
    good = {d for d, q, t in labels if q == 1 and not t and d is not None}
    model = KneserNey([r[1] for r in rows if r[0] in good])
    known: dict = {}
    bits = [known[r[1]] if r[1] in known else known.setdefault(r[1], model.bits(r[1])) for r in rows]
    adjusted = [b - quality.SPREAD / math.sqrt(len(r[1])) if b is not None else None for b, r in zip(bits, rows, strict=True)]
    fold = lambda t: chained(None if t is None else t.encode()) & 1
    halves = [KneserNey([r[1] for r in rows if r[0] in good and fold(r[1]) == k]) for k in (0, 1)]
    by_lang = defaultdict(list)
    for r in rows:
        if r[0] in good and r[1]:
            by_lang[r[2]].append(halves[1 - fold(r[1])].bits(r[1]) - quality.SPREAD / math.sqrt(len(r[1])))
    every = [a for some in by_lang.values() for a in some]
    limit = lambda some: float(np.quantile(some, quality.QUANTILE)) + 1 / math.sqrt(len(some)) if some else None
    own = {k: limit(v) for k, v in by_lang.items() if k is not None}
    return [(b, a, own.get(r[2], limit(every))) for b, a, r in zip(bits, adjusted, rows, strict=True)]


# near copies


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def near_classes(rows: list[tuple]) -> dict[int, int]:
    """Least doc_id that links reach from each doc_id."""
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    least = {d: d for d, _ in sets}
    changed = True
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


# decontamination


def folded(text: str | None) -> str:
    out = []
    for c in text or "":
        low = c.lower() if c.isalnum() else " "
        out.append(low if len(low) == 1 else c)
    return re.sub(" +", " ", "".join(out)).removeprefix(" ")


def probes_of(text: str | None, size: int, step: int, least: int) -> list[str]:
    text = folded(text).removesuffix(" ")
    if len(text) < least:
        return []
    starts = list(range(0, max(1, len(text) - size + 1), step))
    if starts[-1] + size < len(text):
        starts.append(len(text) - size)
    return [text[s : s + size] for s in starts]


def least_edits(probe: str, text: str) -> int:
    """Edit distance of the probe to the part of the text that is nearest to it."""
    chars = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    place = np.arange(len(chars) + 1, dtype=np.int32)
    cost = np.zeros(len(chars) + 1, dtype=np.int32)
    for i, c in enumerate(probe, 1):
        step = cost + 1
        step[1:] = np.minimum(step[1:], cost[:-1] + (chars != ord(c)))
        step[0] = i
        cost = np.minimum.accumulate(step - place) + place
    return int(cost.min())


def leaks(texts: list[str | None], items: list[tuple], d) -> list[tuple[int, int, int, int]]:
    """(row, item_id, probes found, their edits)."""
    out = []
    for i, text in enumerate(texts):
        fold = folded(text)
        for item, body in sorted({x for x in items if x[0] is not None}, key=str):
            probes = list(enumerate(probes_of(body, d.PROBE, d.STEP, d.LEAST_ITEM)))
            found = [e for _, p in probes for e in [least_edits(p, fold)] if e <= int(len(p) * d.ERRORS)]
            if found:
                out.append((i, item, len(found), sum(found)))
    return out


# mixing


def size_of(text: str | None) -> int:
    return len(WORD.findall(text or ""))


def targets(rows: list[tuple]) -> dict:
    """(size, target) by source, of rows (doc_id, text, lang, source, ...)."""
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(size_of(r[1]) for r in rows if r[3] == s) for s in names}
    fixed: dict = {s: Fraction(0) for s in names if not size[s]}
    while True:
        left = Fraction(3, 2) * sum(size.values()) - sum(fixed.values())
        rest = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 2 * size[s]]
        if not above:
            return {s: (size[s], fixed.get(s, share.get(s))) for s in names}
        fixed |= {s: Fraction(2 * size[s]) for s in above}


def taken(rows: list[tuple], seed: int, ranges: int) -> list[int]:
    """Words taken of each row: whole copies, then one more in seeded order until the target is met."""
    by_source = targets(rows)
    out = [0] * len(rows)
    for source, (size, target) in by_source.items():
        copies, rest = divmod(round(target), size) if size else (0, 0)
        groups = defaultdict(list)
        for i, r in enumerate(rows):
            if r[3] == source:
                h = chained(seed.to_bytes(4, "little"), None if r[0] is None else str(r[0]).encode(), None if r[1] is None else r[1].encode())
                groups[(h >> 1) % ranges, signed(h)].append(i)
        for _, some in sorted(groups.items()):
            of = sum(size_of(rows[i][1]) for i in some)
            for i in some:
                own = size_of(rows[i][1])
                out[i] = copies * own + (own if of <= rest else own * rest // of if of else 0)
            rest = max(0, rest - of)
    return out


# tokens


def token_rows(rows: list[tuple], model, end: int = 2) -> list[tuple[int | None, int, int, int]]:
    place, out = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, end]
        out.append((r[0], place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        place += len(ids)
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
