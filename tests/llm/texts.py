"""Awkward texts that several tests share."""

import random

LETTERS = "aaabcdeéßñ  \t\n.,!'0912日本语emoji😀  ▁<s>"


def random_texts(n, seed=1, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(most))) for _ in range(n)]


AWKWARD = [
    None,
    "",
    " ",
    "   ",
    "\n\n",
    "a",
    "<s>x</s> <unk> <|endoftext|> <0x0A>",
    "don't won't I'll they've",
    "▁a▁ ▁",
    "\x00 \x01",
    "word " * 3000,
    "a" * 3000,
    "ab" * 700 + " " * 900 + "\n" * 5,
    "　x y​z",
]
