"""Parts of text rules (Java regex).  What repeats is possessive: the regex engine runs such a group as a loop, so a list of
any length takes no stack."""
import re
import unicodedata

from citegrove.rules import OCR_CONFUSIONS


def one_of(*choices: str) -> str:
    return "(?:" + "|".join(choices) + ")"


def maybe(*parts: str) -> str:
    return "(?:" + "".join(parts) + ")?"


def many(*parts: str) -> str:
    return "(?:" + "".join(parts) + ")*+"


def some(*parts: str) -> str:
    return "(?:" + "".join(parts) + ")++"


def damaged(words: str) -> str:
    """Rule for words that tolerates OCR damage and accents that come and go (use with `(?iu)`)."""
    def letter(c: str) -> str:
        looks = OCR_CONFUSIONS.get(c, [])
        if all(len(x) == 1 for x in looks):
            return f"[{c}{''.join(looks)}]" if looks else re.escape(c)
        return one_of(c, *looks)
    return r"\s++".join("".join(map(letter, plain(word))) for word in words.split())


def plain(word: str) -> str:
    """Without accents, but with the cedilla that scans turn into c."""
    return "".join(c if c == "ç" else unicodedata.normalize("NFD", c)[0] for c in word)


def any_word(words: list[str]) -> str:
    """One of some words with their damage, longer ones first."""
    return one_of(*[damaged(w) for w in sorted(words, key=len, reverse=True)])


def by_beginning(words: list[list[str]]) -> str:
    """One of some words, given sign by sign; words that begin alike share a branch, so a sign is tried once and not once a word.  It matches what the
    plain list matches, longer words first."""
    branches: dict[str, list[list[str]]] = {}
    for w in words:
        if w:
            branches.setdefault(w[0], []).append(w[1:])
    rules = [sign + by_beginning(rest) for sign, rest in branches.items()]
    if [] in words:
        return maybe("|".join(rules)) if rules else ""
    return rules[0] if len(rules) == 1 else one_of(*rules)


SPACE, GAP = r"\s*+", r"\s++"
NUMBER_SIGN = rf"n{SPACE}[º°o.]*+{SPACE}"
