"""Documents with nulls, ties, repeated rows, long and empty texts."""

import random

#: Names that operators use themselves, here as columns of the input.
CLASHES = ("score", "start", "key", "text_key", "row_key", "place", "toxicity", "redacted", "n", "bin", "size", "part", "round", "copies", "label", "id")


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("an", "the", "or", "Ti", "éau", "sch", "re", "on")) for _ in range(r.randint(1, 4))) for _ in range(words))


def odd_rows() -> list[tuple]:
    long = prose(1, 30_000)
    return [
        (1, prose(2, 120), "en", "a", 1),
        (2, None, "en", "a", 2),
        (3, "", None, None, None),
        (4, "   \n\t ", "de", "b", 3),
        (5, long, "en", "b", 4),
        (6, "x" * 150_000, "en", "b", 5),
        (7, "mail a.b@mail5.example.com, call +1 (743) 555-3824", "en", "c", 6),
        (7, prose(3, 80), "fr", "c", 7),
        (8, prose(2, 120), "en", "a", 8),
        (8, prose(2, 120), "en", "a", 8),
        (None, prose(4, 60), "es", None, 9),
        (None, prose(4, 60), "es", None, 9),
        (None, None, None, None, None),
        (9, "日本語 テスト 😀 ퟿ <turn> \\n </turn>", "ja", "ü", 10),
    ]
