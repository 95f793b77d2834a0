"""Small tables with the cases that every operator has to stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size int, fp string, gone_id int, pattern string, label int"


def docs(spark, texts, first=0):
    """A table of texts; the other columns clash with names that operators use inside."""
    rows = [(first + i, t, "en", f"s{i % 3}" if i % 7 else None, 0, 1, "k", 2, "f", 3, "p", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=120, seed=5, words=60, most=160):
    """Random texts with copies, near copies and shared passages, and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    out = [None, "", " \n\t", "one", "one two", "A\u00a0B \u0085 C", "\u00c9t\u00e9 \u00df", "x " * 3000]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.15 and len(out) > 12:
            text = rng.choice(out[8:])
            text = text.upper() if rng.random() < 0.5 else text
        elif kind < 0.35 and len(out) > 12:
            parts = rng.choice(out[8:]).split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
            text = " ".join(parts)
        else:
            parts = [rng.choice(vocabulary) for _ in range(rng.randrange(1, most))]
            if kind < 0.6:
                start = rng.randrange(20)
                parts[len(parts) // 2 : len(parts) // 2] = passage[start : start + rng.randrange(40, 70)]
            text = " ".join(parts).replace(" w7 ", ". ").replace(" w8 ", "\n")
        out.append(text)
    return out
