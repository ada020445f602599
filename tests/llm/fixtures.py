"""Small documents with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re

import xxhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, id int, row string, __host string, kept int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (f"{r.randrange(50)}" if r.random() < 0.5 else "") for _ in range(n))


def texts() -> list:
    long = prose(1, 30_000)
    base = prose(2, 400)
    near = [" ".join(base.split()[:k] + ["changed"] + base.split()[k + 1 :]) for k in (5, 50, 100, 200, 300, 399)]
    return [
        None, "", " \t\r\n", "one", "One", "two words", "three small words", long, long, base, base, *near,
        "spam " * 200, "Zürich ÉCOLE straße 東京 \U0001f600 " * 20, "\n\n".join([prose(3, 30)] * 6),
        *[prose(k, 60 + k) for k in range(10, 22)], "X" * 5000, "no space" + " " * 30 + "between\x1cthese\x85words",
    ]


def rows() -> list:
    out = []
    for i, t in enumerate(texts()):
        doc = None if i in (4, 12) else 7 if i in (13, 14) else i
        out.append((doc, t, [None, "en", "fr", "de"][i % 4], [None, "a", "b"][i % 3], None if t is None else len(t), "x", None, i, "r", "h", 1))
    return out + out[:10]


def documents(spark, given=None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA)


def simhash(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints: list[int], radius: int = 4) -> list[int]:
    """Smallest place reachable over links of at most ``radius`` bits."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(prints))]


def plain_words(text) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(text, items: list) -> tuple:
    """(words, hit words, items, sorted ids) by looking everywhere."""
    words, hit, met = plain_words(text), set(), set()
    for k, (item, body) in enumerate(items):
        iw = plain_words(body)
        m = min(10, len(iw))
        grams = {tuple(iw[s : s + m]) for s in range(len(iw) - m + 1)} if iw else set()
        for s in range(len(words) - m + 1):
            if m and tuple(words[s : s + m]) in grams:
                hit |= set(range(s, s + m))
                met.add(str(item) if item is not None else None)
    return len(words), len(hit), len(met), sorted(x for x in met if x is not None)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
