"""Plain Python statements of what the operators return, and a table of odd rows."""

import hashlib
import re
import zlib
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hash long, key string, sig string, mix_size long, n long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PASSAGE = "the quick brown fox jumps over one lazy dog and then it runs far away from here "


def odd_rows():
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    texts = {
        1: None, 2: "", 3: " \t\n", 4: "Alpha beta gamma delta", 5: "alpha BETA gamma delta", 6: "alpha\tbeta gamma\ndelta",
        7: PASSAGE * 9, 8: PASSAGE * 9, 9: "x" + PASSAGE * 8 + "y", 10: "été où ça ÉTÉ ẖ H̱ ﬁ", 11: "1234 !!! ...", 12: long, 13: long + " end",
        14: "a", 15: "it's <|endoftext|> DON'T é <|x|>", 16: "aaaa" * 300, 17: "line one here\nline one hare\nline two\nline one here\n\n", 18: "alphabetagammadelta",
        19: "Some words. Released under the MIT License. And more words follow here.",
    }
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 5 else None, None, "r", 1, "k", "s", 2, 3) for i, t in texts.items()]
    rows += [rows[6], rows[3]]  # repeated rows
    rows += [(None, "alpha beta gamma delta", None, "", 1, None, None, None, None, None, None), (20, None, None, None, None, *[None] * 6)]
    return rows


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOW))


def shingles(text, k):
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(docs, k=2):
    sets = [shingles(t, k) for _, t in docs]
    group = list(range(len(docs)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(top(i), []).append(d)
    pick = lambda ids: min((x for x in ids if x is not None), default=None)
    return [(d, len(s), pick(least[top(i)]), d == pick(least[top(i)])) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def repeats(docs, size):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[p:p + size] for b in raw for p in range(len(b) - size + 1))
    out = []
    for (d, _), b in zip(docs, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p:p + size]] > 1:
                gone[p:p + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, t in items:
        w = words(t, pattern)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, found = words(t, pattern), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def token_rows(docs, tokenizer):
    out, start = [], 0
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((d, start, len(ids), zlib.crc32(data)))
        start += len(ids)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_counts(docs, edits):
    seen, out = [], []
    for d, t in docs:
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        equal = near = 0
        for x in lines:
            if x in seen:
                equal += 1
                continue
            near += any(abs(len(x) - len(y)) <= edits < min(len(x), len(y)) and distance(x, y) <= edits for y in seen)
            seen.append(x)
        out.append((d, len(lines), equal, near))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)
