"""Small documents with every awkward case, and plain-Python versions of the operators."""

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; a table that has them too must not disturb.
CLASHES = ("ids", "spans", "score", "size", "start", "block", "words", "place", "bucket", "marks", "cls", "label",
           "sketch", "node", "uid", "host", "path", "x", "dim", "group", "component_id", "n_tokens", "entries", "runs", "mixed_uid",
           "mixed_words", "near_text", "near_key", "row_key", "tokens", "low", "gram", "zone", "item", "rank", "zone_marks")

_R = random.Random(7)
WORDS = ["ab", "the", "stone", "River", "éclair", "moon", "of", "x1", "greenhouse", "漢字", "and", "lamp", "forty", "Ω"]
LONG = " ".join(_R.choice(WORDS) + str(_R.randint(0, 999)) for _ in range(6000))
PASSAGE = " ".join(_R.choice(WORDS) + str(_R.randint(0, 99)) for _ in range(60))
ROWS = [
    (3, None), (1, ""), (2, "   \n\t "), (4, "one"), (5, "one two"), (6, LONG), (7, LONG), (8, PASSAGE),
    (9, "before " + PASSAGE + " after it"), (10, "a b c d"), (10, "a b c d"), (11, "A B C D"), (12, "x" * 3000),
    (None, PASSAGE), (None, None), (13, "emoji 😀😀 and \u200b hidden"), (14, PASSAGE[:-12] + " changed"), (15, "one"),
]


def docs(spark, rows=ROWS, extra=True):
    full = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"src{k % 3}", None)
            for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES])
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_components(rows, n, threshold):
    """Exhaustive: ``[(doc_id, set size, component id)]`` in the rows' order."""
    sets = []
    for _, t in rows:
        w = words((t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, s in enumerate(sets):
        for j, same in Counter(j for x in s for j in where[x] if j < k).items():
            if 100 * same >= 100 * threshold * (len(s) + len(sets[j]) - same):
                up[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]
