"""Plain versions of the operators, one text at a time."""

import hashlib
import re
import zlib
from collections import Counter

SPACES = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counts(text):
    w, text = words(text), text or ""
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits=2):
    """prints: (doc_id, fingerprint); doc_id of a row's component, row by row."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        least[find(f)] = min(d, least.get(find(f), d))
    return [least[find(f)] for _, f in prints]


def secret_spans(text):
    text, out = text or "", []
    patterns = [
        ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]+", 0, 32),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
        ("hub", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 1),
    ]
    for k, (_, p, g, least) in enumerate(patterns):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[g]) >= least]
    return [(patterns[k][0], a, b) for a, k, b in sorted(out)]


def kept_words(docs, window=13):
    """docs: (doc_id, text); (doc_id, n_words, n_removed, kept text) of each row."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for d, t in docs:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def dc_thumbnail(raw):
    """Luminance DC samples of the first image of a one-component file, bit by bit."""
    at, tables, q = 2, {}, {}
    while True:
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            q[body[0] & 15] = body[1:65]
        elif marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            quantiser = body[8]
        elif marker == 0xC4:
            codes, code, k = {}, 0, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    codes[(n, code)] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = codes
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            break
    out, blocks = [], (-(-width // 8)) * (-(-height // 8))
    end = at
    while not (raw[end] == 0xFF and raw[end + 1] not in (0, *range(0xD0, 0xD8))):
        end += 1
    for part in re.split(b"\xff[\xd0-\xd7]", raw[at:end]):
        data = part.replace(b"\xff\x00", b"\xff")
        bits = "".join(f"{b:08b}" for b in data)
        p = level = 0

        def symbol(codes):
            nonlocal p
            n = 1
            while (n, int(bits[p : p + n], 2)) not in codes:
                n += 1
            p += n
            return codes[(n, int(bits[p - n : p], 2))]

        for _ in range(min(interval or blocks, blocks - len(out))):
            s = symbol(tables[0])
            v = int(bits[p : p + s] or "0", 2)
            p += s
            level += v if not s or v >> (s - 1) else v - (1 << s) + 1
            k = 1
            while k < 64:
                rs = symbol(tables[16])
                if not rs:
                    break
                k += (rs >> 4) + 1
                p += rs & 15
            out.append(max(0, min(255, int((level * q[quantiser][0] / 8 + 128.5) // 1))))
    return width, height, bytes(out)


def rule_stats(text):
    """The seven statistics of a text that a learned rule looks at."""
    n, chars, symbols, dup_lines, repeated = counts(text)
    text = text or ""
    lines = sum(1 for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x))
    share = lambda a, b: a / b if b else 0.0
    return (float(n), share(chars, n), share(symbols, chars), share(dup_lines, lines), share(repeated, n), share(sum("A" <= c <= "Z" for c in text), chars), share(text.count("!"), n))


def decision_list(rows, thresholds=12, max_rules=8, max_conditions=3, precision=0.97, least=3):
    """rows: (statistics, label, whether it prunes). Rules as lists of (statistic, over, threshold), by sequential covering."""
    import math

    cuts = []
    for s in range(len(rows[0][0])):
        found = set()
        for label in {r[1] for r in rows}:
            own = sorted(r[0][s] for r in rows if r[1] == label)
            found |= {own[math.ceil((k + 0.5) / thresholds * len(own)) - 1] for k in range(thresholds)}
        cuts.append(sorted(found))
    conditions = [(s, over, c) for s in range(len(cuts)) for c in cuts[s] for over in (True, False)]
    hit = lambda c, x: (x[c[0]] > c[2]) == c[1]
    left, out = list(rows), []
    while len(out) < max_rules:
        rule, grow = [], [r for r in left if not r[2]]
        while len(rule) < max_conditions:
            p0, n0 = sum(r[1] == 0 for r in grow), sum(r[1] == 1 for r in grow)
            best, most = None, 0.0
            for c in conditions if p0 and n0 else ():
                inside = [r[1] for r in grow if hit(c, r[0])]
                p, n = inside.count(0), inside.count(1)
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                if gain > most + 1e-9:
                    best, most = c, gain
            if best is None:
                break
            rule.append(best)
            grow = [r for r in grow if hit(best, r[0])]
        worth = []
        for k in range(1, len(rule) + 1):
            inside = [r[1] for r in left if r[2] and all(hit(c, r[0]) for c in rule[:k])]
            p, n = inside.count(0), inside.count(1)
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        if not worth or max(worth)[2] < least or max(worth)[2] < precision * sum(max(worth)[2:]):
            break
        rule = rule[: -max(worth)[1]]
        out.append(rule)
        left = [r for r in left if not all(hit(c, r[0]) for c in rule)]
    return out
