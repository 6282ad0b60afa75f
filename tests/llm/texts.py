"""Odd texts for round trips."""

import random

ODD = [" ", "  ", "\n", "\t", "a", "the", "'s", "'re", "'", '"', "1", "23", "é", "ß", "€", "漢", "🙂", "\x1c", "\x85", "<|endoftext|>", "<|endof", ".", "!!", "_", "²", "ª", " \n ", "\r\n", "<|startoftext|>", "İ", "Σ", "é"]


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(n)]
