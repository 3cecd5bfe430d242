"""Documents with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, n int, key string, ids string, g double"


def sample(seed=1, n=60, vocabulary=40, words=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    texts = []
    for _ in range(n):
        text = [rng.choice(vocab) for _ in range(rng.randint(0, words))]
        if texts and rng.random() < 0.4:
            text = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 2)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(vocab)
        texts.append(" ".join(text))
    return texts


def rows(texts, start=0):
    return [(start + i, t, "en", 1, "k", "x", 0.5) for i, t in enumerate(texts)]


def awkward():
    """Null and empty texts, null ids, repeated rows, white space only, one word, non-ASCII, a very long text."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    texts = [None, "", " \t\n ", "one", "é ü 日本 😀 '’ s", long, long, "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p"]
    return [*rows(texts), (None, "a b c d e f g h i j k l m n o p", "en", 1, "k", "x", 0.5), (None, None, None, None, None, None, None), (3, "one", "en", 1, "k", "x", 0.5)]
