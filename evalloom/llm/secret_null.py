"""How letters follow each other in identifiers: where ``secrets.CHANGES`` comes from. ``python -m evalloom.llm.secret_null`` prints it.

Identifiers are made of words and numbers, joined in camel case, in small letters, in mixed case with dashes and underscores, as
paths, or in capitals. Another list of words (a file, one a line) gives another table, for corpora whose identifiers differ.
"""

from __future__ import annotations

import random
import sys

from .secrets import ALPHABETS, KINDS_OF_LETTERS, encoding

#: Common words of identifiers.
WORDS = """account action address agent allow answer array backup block buffer build button cache call change channel check class
client cloud code color column commit config content context control copy count create current cursor data date debug default
delete deploy device display document domain driver email enable engine entry error event export feature field file first flag
folder format frame function gateway graph group handler header height host image import index info input insert instance item key
label language last layer layout length level library limit line link list load local lock log main manager map memory menu
message method mode model module month name network next node notice number object offset open option order output owner package
page parent parse path payment phone place player plugin point policy port post price process product profile project public
query queue random range record region report request reset result retry return role""".split()
STYLES = ("camel", "small", "mixed", "path", "capitals")


def identifier(rng: random.Random, words: list[str], length: int) -> str:
    """One identifier, cut to a length."""
    style, out = rng.choice(STYLES), ""
    while len(out) < length:
        word = rng.choice(words) if rng.random() < 0.75 else str(rng.randrange(10 ** rng.randrange(1, 5)))
        if style == "camel" and out:
            word = word.capitalize()
        elif style == "capitals":
            word = word.upper()
        elif style == "mixed":
            word = rng.choice([word, word.capitalize(), word.upper()])
        joint = {"mixed": rng.choice("-_"), "path": "/", "capitals": "_"}.get(style, "")
        out += (joint if out else "") + word
    return out[:length]


def random_string(rng: random.Random, name: str, length: int) -> str:
    return "".join(rng.choice(ALPHABETS[name]) for _ in range(length))


def candidates(rng: random.Random, words: list[str], length: int, count: int) -> list[str]:
    """As many identifiers that have an encoding, so hold digits and letters."""
    out: list[str] = []
    while len(out) < count:
        s = identifier(rng, words, length)
        if encoding(s) is not None:
            out.append(s)
    return out


def changes(strings: list[str]) -> list[list[float]]:
    """Share of each kind of letter after each kind, with one more of each for those never seen, in thousandths, at least one."""
    seen = [[1] * 6 for _ in range(6)]
    for s in strings:
        kinds = [KINDS_OF_LETTERS[c] for c in s]
        for a, b in zip(kinds, kinds[1:]):
            seen[a][b] += 1
    return [[max(0.001, round(n / sum(row), 3)) for n in row] for row in seen]


def table(words: list[str] = WORDS, seed: int = 1) -> list[list[float]]:
    return changes(candidates(random.Random(seed), words, 24, 20_000))


if __name__ == "__main__":
    for row in table(open(sys.argv[1]).read().split() if len(sys.argv) > 1 else WORDS):
        print(row)
