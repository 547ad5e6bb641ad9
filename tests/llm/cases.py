"""Small adversarial tables and plain versions of what the operators must return."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


def documents(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) or whole rows."""
    return spark.createDataFrame([r if len(r) > 2 else (*r, "en", "s0", None if r[1] is None else len(r[1])) for r in rows], schema)


def noisy(seed: int = 5, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Random texts over few words with shared passages, copies, near copies, nulls, blanks and repeated rows."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß€") for _ in range(rnd.randint(2, 6))) for _ in range(120)]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passages = [say(rnd.randint(36, 70)) for _ in range(4)]
    lines = [say(5) for _ in range(4)]
    out: list = []
    for i in range(n):
        parts = [say(rnd.randint(3, 60))]
        if rnd.random() < 0.5:
            parts.append(rnd.choice(passages))
        if rnd.random() < 0.5:
            parts += rnd.sample(lines, 2)
        parts.append(say(rnd.randint(0, 40)))
        out.append((i, rnd.choice(["\n", " \n", "\n\n"]).join(parts)))
    base = out[3][1] + " " + say(200)
    out.append((n, base))
    for k in range(12):  # near copies of one text, each edited elsewhere
        words = base.split(" ")
        for _ in range(1 + k % 6):
            words[rnd.randrange(len(words))] = "zz%d" % rnd.randrange(999)
        out.append((n + 1 + k, " ".join(words)))
    out += [(n + 20, out[5][1]), (n + 21, out[5][1]), (n + 22, None), (n + 23, ""), (n + 24, " \t\r\n\x0b\x0c "), (n + 25, "one two"), (n + 26, "ONE two"), (n + 27, "a" * 300), (n + 28, "a" * 200)]
    out += [(n + 29, "ab " * 120), (None, out[7][1]), (None, None), out[9], out[9], (n + 30, say(4000)), (n + 31, "\x00\x1f x" + passages[0])]
    return out


def lines_result(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (len(holders.get(key(x), ())) > 1 and d > min(holders[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def phrases_result(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = defaultdict(int)
    for w in words:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] += 1
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), sha(" ".join(kept).encode())))
    return out


def suffix_result(rows, window=50):
    first: dict[bytes, int] = {}
    for d, t in rows:
        if d is not None:
            b = (t or "").encode()
            for i in range(len(b) - window + 1):
                first[b[i : i + window]] = min(d, first.get(b[i : i + window], d))
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - window + 1):
            if d is not None and first[b[i : i + window]] < d:
                gone |= set(range(i, i + window))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(b), len(gone), spans, sha(bytes(x for i, x in enumerate(b) if i not in gone))))
    return out


def near_result(rows, k=5, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d), None if d is None else find(d) == d) for (d, _), s in zip(rows, sets, strict=True)]


def table(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)
