"""Brute-force versions that the operators are held against."""

import collections
import hashlib
import math
import re


def word_sets(texts, k):
    out = []
    for t in texts:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", lowered) if x]
        out.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def components(ids, sets, share):
    """(set size, smallest id reachable) of each row, comparing all sets that have an n-gram in common."""
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        seen = collections.Counter(j for g in s for j in holders[g])
        for j, common in seen.items():
            if 100 * common >= share * (len(s) + len(sets[j]) - common):
                parent[top(i)] = top(j)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(len(s), least[top(i)]) for i, s in enumerate(sets)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def personal(text):
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))
                    or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def plain_context(left, right):
    """The contexts of a string from the texts on both sides."""
    def small(t):
        return re.sub("[0-9]", "0", t.lower())
    words = re.findall(r"\S+", small(left), re.ASCII)[-3:]
    out = [" ".join(words[-k:]) for k in (1, 2, 3) if len(words) >= k]
    return out + [" ".join([*words[-2:], "_", small(re.match(r"\s*(\S*)", right, re.ASCII)[1])])] if out else out


def all_personal(texts, rule):
    """The spans of each text as op10 joins them, with the thresholds of ``rule`` (the operator's module)."""
    placed, base = [], [personal(t) for t in texts]
    unknown = r"(?<![A-Za-z0-9._%+@:/=-])[A-Za-z._%+:/=-]*+[0-9@][A-Za-z0-9._%+@:/=-]*+"
    for row, text in enumerate(texts):
        taken = [tuple(map(int, s.split(":")[1:])) for s in base[row]]
        for kind, pattern in [*PII, ("", unknown)]:
            hits = list(re.finditer(pattern, text or ""))
            for i, m in enumerate(hits):
                left = text[hits[i - 1].end() if i else 0:m.start()]
                right = text[m.end():hits[i + 1].start() if i + 1 < len(hits) else len(text)]
                string, found = m[0], kind
                if kind:
                    if f"{kind}:{m.start()}:{m.end()}" not in base[row]:
                        continue
                else:
                    string = re.sub("[._%+:/=-]+$", "", string)
                    digits, letters = len(re.findall("[0-9]", string)), len(re.findall("[A-Za-z]", string))
                    if len(string) < rule.LEAST_LENGTH or digits < rule.LEAST_DIGITS and "@" not in string:
                        continue
                    if any(a < m.start() + len(string) and m.start() < b for a, b in taken):
                        continue
                    if len(string) == digits + letters and len(string) >= rule.KEY_LENGTH and min(digits, letters) >= rule.KEY_MIX:
                        found = "secret"
                end = m.start() + len(string)
                placed.append((row, found, m.start(), end, re.sub(r"[\s().-]", "", string).lower(), plain_context(left, right)))
    strings, seeds, unknowns = (collections.defaultdict(set) for _ in range(3))
    for _, kind, _, _, string, contexts in placed:
        for c in contexts:
            strings[c].add(string)
            (seeds[c, kind] if kind else unknowns[c]).add(string)
    known = {k: len(v) for k, v in seeds.items() if len(v) >= rule.SUPPORT}
    score = {k: n / len(strings[k[0]]) for k, n in known.items()}
    for _ in range(rule.ROUNDS):
        left_out = collections.defaultdict(float)
        for (c, kind), s in score.items():
            for string in unknowns[c] if s >= 0.5 else ():
                left_out[string, kind] += math.log(max(1 - s, 1e-9))
        score = {(c, kind): min(1.0, (n + sum(1 - math.exp(left_out[u, kind]) for u in unknowns[c] if (u, kind) in left_out)) / len(strings[c]))
                 for (c, kind), n in known.items()}
    out = [[(rule.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in spans)] for spans in base]
    for row, kind, start, end, _, contexts in placed:
        if kind in ("", "secret"):
            best = sorted((-score[c, k], rule.KINDS.index(k)) for c in contexts for k in rule.KINDS
                          if score.get((c, k), 0) >= rule.CONFIDENT and kind in ("", k))
            if best:
                out[row].append((best[0][1], start, end))
    return [",".join(f"{rule.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)) for spans in out]


def sha256(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
