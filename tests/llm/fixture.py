"""Small corpora with copies, near copies, nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string"


def vocabulary(n: int = 400, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(2, 8))) for _ in range(n)]


def prose(r: random.Random, words: list[str], n: int) -> str:
    return "".join(r.choice(words) + r.choice([" ", " ", " ", " ", ". ", ",\n"]) for _ in range(n))


def edited(r: random.Random, text: str, words: list[str], share: float) -> str:
    return " ".join(r.choice(words) if r.random() < share else w for w in text.split(" "))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    r, words = random.Random(seed), vocabulary()
    texts = [prose(r, words, r.choice([3, 20, 60, 120])) for _ in range(n)]
    texts += [texts[k] for k in range(0, 20, 2)]
    texts += [edited(r, texts[k], words, 0.02) for k in range(0, 30) for _ in range(2)]
    passage = prose(r, words, 40)
    texts += [prose(r, words, 30) + "\n" + passage + "\n" + prose(r, words, 30) for _ in range(8)]
    texts += ["", "", None, None, " \t\n ", "one", "one two", "One two", "one two three", prose(r, words, 4000), "x" * 70, "x" * 49]
    ids = list(range(0, 3 * len(texts), 3))
    r.shuffle(ids)
    rows = [(i, t, "en", r.choice(["a", "b", "c", None, "Z"]), None if t is None else len(t), 0.5, "clash") for i, t in zip(ids, texts)]
    return [*rows, rows[0], rows[1], (None, "one two three four five six", None, None, None, None, None), (None, None, None, None, None, None, None)]


def frame(spark, rows: list[tuple], partitions: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def unique_ids(rows: list[tuple]) -> list[tuple]:
    """Rows with an id, one a document, by id."""
    seen = {}
    for row in rows:
        if row[0] is not None:
            seen.setdefault(row[0], row)
    return [seen[k] for k in sorted(seen)]
