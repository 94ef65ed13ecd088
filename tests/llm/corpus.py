"""Small corpora with every odd case, and plain versions of the operators to compare with."""

import collections
import random
import re

SCHEMA = "doc_id long, text string, chunk int, id string, kept string, n_words string"


def docs(seed=1, n=60):
    """Texts that share passages, are copies or near copies; nulls, empties, repeated rows, long ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = " ".join(words(40))
    texts = []
    for i in range(n):
        kind = i % 10
        body = " ".join(words(rng.randint(30, 120)))
        if kind == 3:
            body = " ".join([body, passage, " ".join(words(10))])
        elif kind == 4 and texts:
            body = texts[rng.randrange(len(texts))]
        elif kind == 5 and texts:
            w = texts[rng.randrange(len(texts))].split(" ")
            for _ in range(2):
                w[rng.randrange(len(w))] = "CHANGED"
            body = " ".join(w)
        elif kind == 6:
            body = "  ".join([passage, passage]) + "\n" + body.upper()
        elif kind == 7:
            body = "ab " * rng.randint(1, 400)
        texts.append(body)
    texts += ["", " \n\t ", "one", "two words", "a b c d", "a b c d", "é" * 40, "x" * 3000 + " " + "x" * 70, "日本語 " * 30, "\x00\x1f " * 30]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k, texts[k]) for k in order]
    rows += [(500, None), (None, texts[0]), (None, "null id, its own text"), (7, texts[7]), (7, texts[8]), (3, texts[3])]
    return [(i, t, 5, "x", "no", "z") for i, t in rows]


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode())


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda x: tuple((v is None, v) for v in x))


def counted(rows):
    return collections.Counter(rows)
