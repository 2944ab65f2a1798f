"""Texts for the tests of this folder."""

# (doc_id, text, source): null and empty texts, ties, repeated rows, a null id, a long text
ODD = [
    (1, None, None), (2, "", "a"), (3, "   \n\t ", "a"), (4, "one", "a"), (4, "one", "a"),
    (None, "one two three four five six seven", "b"), (5, "one two three four five six seven", "b"),
    (6, "word " * 5000, "b"), (7, "ünï çödé " * 40, None), (8, "a\nb\na\n" * 30, "c"), (9, "<|endoftext|> x", "c"),
]

_SYLLABLES = "ka lo mi ra ten ous vel ni sor eth an du pel gri mo".split()


def prose(rng, n, lines=True):
    """``n`` words of invented prose."""
    words = ["".join(rng.choices(_SYLLABLES, k=rng.randrange(1, 4))) for _ in range(n)]
    ends = [rng.choice((" ", " ", " ", " ", ". ", ".\n" if lines else ". ")) for _ in words]
    return "".join(w + e for w, e in zip(words, ends)).strip()
