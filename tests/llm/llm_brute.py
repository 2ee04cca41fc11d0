"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_classes(rows, threshold=0.8):
    """Per row number: number of links to other rows and least row number reached by links."""
    sets = [shingles(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
            s = len(x & y)
            if s >= threshold * (len(x) + len(y) - s) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return links, [find(i) for i in range(len(rows))]


def leaks(text, items, threshold=0.8):
    have = shingles(text)
    return {k for k, t in items if (want := shingles(t)) and len(want & have) >= threshold * len(want) - 1e-9}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def repeats(w, least):
    """Words in windows of five found twice, words covered by repeats of ``least`` words, longest repeat."""
    n = len(w)
    count = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    window = {j for i in range(n - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    covered, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            covered.update(range(i, i + best))
            longest = max(longest, best)
    return len(window), len(covered), longest


def payload(html):
    data = (html or "").encode()
    return len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()


def cheapest_repair(rows):
    """Cheapest audit and repaired lines by Dijkstra over (rows consumed, initials so far); rows are (role, text, fault)."""
    import heapq

    def step(q, initial):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initial))

    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(lines)
        for role in ("user", "assistant"):
            to = step(q, role[0])
            if to is not None:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*lines, role + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for letter, name, extra in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    to = step(q, name[:1])
                    if to is not None:
                        heapq.heappush(heap, (cost + extra + more, audit + letter, i + 1, to, (*lines, f"{name}:{text}")))


def conversation_report(rows):
    """Report per conversation of rows (conv_id, turn, role, text), as they are damaged by their hash."""
    import zlib

    by, space = {}, lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        code = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if code == 4 else space(role), "" if code == 1 else space(text)
        text = re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = cheapest_repair([(r, t, f) for (_, r, t), f in zip(kept, faults)])
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out
