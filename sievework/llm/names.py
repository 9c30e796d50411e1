"""A small classifier that tells family names from other words by their letters, trained on a bounded sample.

Labels come from the corpus itself: a word whose letters make up a mail address beside it is a family name (and the word
before it a given name); words that occur in lower case, words of addresses and product phrases are none.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

BUCKETS = 1 << 15
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ADDRESS = re.compile(r"\S*(?:@|\(at\)|\[at\])\S*", re.I)
_LOCAL = re.compile(r"([\w.%\-]+)(?:\+[\w\-]+)?\s?(?:@|\(at\)|\[at\])", re.I)
PARTICLES = frozenset("von van de der den del della di da dos du la le zu zum ter ten af av bin ibn".split())


def folded(word: str) -> str:
    """Lower case without accents, as in mail addresses."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower().replace("ß", "ss")) if not unicodedata.combining(c))


def _grams(word: str) -> list[int]:
    w = f"^{word.lower()}$"
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in (2, 3, 4, 5) for i in range(len(w) - n + 1)]


@dataclass
class NameModel:
    """Weights of the letter groups, the given names that were seen, and the words known to be ordinary."""

    weights: np.ndarray
    given: frozenset[str]
    ordinary: frozenset[str]
    families: frozenset[str] = frozenset()
    cache: dict[str, bool] = field(default_factory=dict, repr=False)
    pieces: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "pieces": {}}

    def families_in(self, text: str) -> set[str]:
        """Words of a text that can be family names; what stands between blanks is looked up as a whole first."""
        out: set[str] = set()
        pieces = self.pieces
        for piece in set(text.split()):
            known = pieces.get(piece)
            if known is None:
                if len(pieces) > 500_000:
                    pieces.clear()
                known = pieces[piece] = tuple(w for w in WORD.findall(piece) if self.is_family(w.split("'")[0])) if len(piece) > 3 else ()
            if known:
                out.update(known)
        return out

    def is_family(self, word: str) -> bool:
        """Whether a word of any case can be a family name."""
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            known = self.cache[word] = self._decide(word)
        return known

    def _decide(self, word: str) -> bool:
        low = word.lower()
        if len(low) < 4 or low in self.ordinary or low in self.given:
            return False
        if low in self.families:
            return True
        if not word.isascii() and not word.isalpha() and "-" not in word and "'" not in word:
            return False
        if any(c.isupper() for c in word[1:]) and not word.isupper() and "-" not in word:
            return False  # a name of code
        grams = _grams(low)
        # a capital is evidence too; and a family name counts only beside a given name or an initial
        least = -0.75 if word[:1].isupper() and not word.isupper() else 0.0
        return bool(self.weights[grams].sum() / len(grams) ** 0.5 + self.weights[BUCKETS] > least)

    def is_given(self, word: str) -> bool:
        low = word.lower()
        if low in self.given:
            return True
        return word[:1].isupper() and len(word) > 2 and low not in self.ordinary and word.isalpha() and not self.is_family(word)


def labelled(lines: list[str], given: set[str]) -> tuple[Counter, Counter]:
    """Family and given names that lines with mail addresses prove."""
    families: Counter[str] = Counter()
    firsts: Counter[str] = Counter()
    for line in lines:
        for m in _LOCAL.finditer(line):
            local = folded(m.group(1))
            parts = [p for p in re.split(r"[._%\-\d]+", local) if p]
            joined = "".join(parts)
            words = WORD.findall(line[: m.start()])[-6:] + WORD.findall(line[m.end() :])[:4]
            for a, b in zip(words, words[1:]):
                fa, fb = folded(a), folded(b)
                if parts == [fb, fa]:  # the family name stands in front
                    a, b, fa, fb = b, a, fb, fa
                if len(fb) < 4 or fa == fb:
                    continue
                if joined in (fa + fb, fa[:1] + fb):
                    families[b.lower()] += 1
                    if len(fa) > 1 and (parts == [fa, fb] or joined == fa[:1] + fb):
                        firsts[a.lower()] += 1
    for name in given:
        families.pop(name, None)
    return families, firsts


def train(texts: list[str], contact_lines: list[str], given_names: list[str], rounds: int = 12) -> NameModel:
    """Fits the classifier by logistic regression on hashed letter groups; the order of the sample does not matter."""
    given = {g.lower() for g in given_names}
    families, firsts = labelled(contact_lines, given)
    lower: Counter[str] = Counter()
    title: Counter[str] = Counter()
    for text in texts:
        words = WORD.findall(_ADDRESS.sub(" ", text))
        lower.update(w for w in words if w.islower())
        title.update(w.lower() for w in words if w[0].isupper() and not w.isupper())
    families = Counter({w: n for w, n in families.items() if lower[w] <= 3 + title[w]})
    # a given name that is also an everyday word stays a given name: what follows it decides
    given |= {w for w in firsts if w not in families and (lower[w] <= 3 + title[w] or firsts[w] > 2)}
    ordinary = {w for w, n in lower.items() if n >= 3 and n > title[w] / 2 and w not in families and len(w) > 1}
    positives, negatives = sorted(families), sorted(w for w in ordinary | (set(lower) & set(title)) if w not in families and len(w) > 3)
    towns = sorted({w.lower() for text in texts for w in re.findall(r"\d[\w.]*,? (?:[NSEW]\. )?([A-ZÀ-Þ][\w\-]{3,}) ?[A-Z\d]?", text)} - set(families))
    seconds = sorted(w for w in given if w not in families)
    examples = [(_grams(w), 1.0) for w in positives] + [(_grams(w), 0.0) for w in [*negatives, *towns, *seconds]]
    weights = np.zeros(BUCKETS + 1)
    weights[BUCKETS] = -1.0  # most words are no names
    if positives and negatives:
        order = sorted(range(len(examples)), key=lambda i: zlib.crc32(str(i).encode()))
        share = len(positives) / len(examples)
        for turn in range(rounds):
            rate = 0.5 / (1 + turn)
            for i in order:
                grams, y = examples[i]
                scale = len(grams) ** -0.5
                p = 1 / (1 + np.exp(-np.clip(weights[grams].sum() * scale + weights[BUCKETS], -30, 30)))
                step = rate * (y - p) * (min(1 / share, 8) if y else 1.0)
                np.add.at(weights, grams, step * scale)
                weights[BUCKETS] += 0.1 * step
    else:
        weights[BUCKETS] = -1.0
    model = NameModel(weights, frozenset(), frozenset(ordinary), frozenset(families))
    # of two family names in a row the first is no given name
    listed = {g.lower() for g in given_names}
    return NameModel(weights, frozenset(listed | {w for w in given if firsts[w] > families[w]}), frozenset(ordinary), frozenset(families))
