"""Made-up text for the tests."""


def prose(rng, n):
    return " ".join(rng.choice(("the", "river", "stone", "and", "walks", "over", "night", "quiet", "paper", "of", "seven", "hills")) + str(rng.randrange(60)) for _ in range(n))
