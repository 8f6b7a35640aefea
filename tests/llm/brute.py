"""Plain Python versions of what the operators return, written from their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = r"[^\x20\x09-\x0D]+"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digest(spans):
    return hashlib.sha256(written(spans).encode()).hexdigest()


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def personal(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return found


def secrets(text):
    found = []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end(), "hex"))
    return found


def quality(text):
    words = re.findall(WORD, text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, repeated, len(covered), failed


def fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Least id reachable for each id, by fingerprints at most 3 bits apart."""
    distinct = sorted(set(prints.values()))
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                parent[root(y)] = root(x)
    members = defaultdict(list)
    for key, x in prints.items():
        members[root(x)].append(key)
    return {key: min(group) for group in members.values() for key in group}


def top(rows, k=5):
    """rows: id to integer vector."""
    out = set()
    for q, v in rows.items():
        if q % 50 == 0:
            scored = sorted((-int(np.dot(v, w)), i) for i, w in rows.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rebuilt(turns):
    """``{conv_id: [(role, text), ...]}`` of ``(conv_id, turn, role, text)`` rows without ties."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    return out


def trie(conversations):
    """Rows as ``op11`` has them, from ``{conv_id: [(role, text), ...]}``."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]].append(path)
    parents = Counter(p[:-1] for p in members if p)
    rows = set()
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(conversations[c]) == len(path))))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below[path] if p)
        leaves = sum(1 for p in below[path] if not parents[p])
        above = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.add((min(convs), len(path), above, len(convs), parents[path], leaves, saved, digest))
    return rows


def dictionary(docs):
    """``{word: n}`` as ``op12`` counts them, from ``(doc_id, text)`` rows."""
    words = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def spelled(words, ratio=5):
    """Rows as ``op12`` has them, every word against every other."""

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, rows = {}, set()
    for w in words:
        others = [v for v in words if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = (len(others), best if best and words[best] >= ratio * words[w] else None)
    for w, n in words.items():
        root = w
        while forms[root][1]:
            root = forms[root][1]
        form = forms[w][1]
        rows.add((w, n, forms[w][0], form, words.get(form), root))
    return rows


def licensed(text):
    """``n_words`` and the base places ``[(label, word)]`` of ``op13``."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = []
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        own = phrase.split()
        places += [(label, i) for i in range(len(words)) if words[i : i + len(own)] == own]
    return words, places
