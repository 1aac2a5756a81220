"""Made-up prose for the tests of this folder."""

import random

WORDS = [f"{a}{b}{c}" for a in ("al", "be", "co", "du", "el", "fi") for b in ("nar", "tov", "mir", "sel", "pol") for c in ("a", "en", "ish", "or")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))
