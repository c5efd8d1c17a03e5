"""License scan: Aho-Corasick phrases and tags, shunting-yard licence expressions."""

import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.llm.common import normal_words

# Phrases of the base labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notice phrases with labels of their own, in words.
NOTICE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "all rights reserved": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
# How freely a licence lets text be used, from 0 to 1, by the start of its identifier.
FREEDOM = (
    ("cc-by-nc", 0.2), ("cc-by-nd", 0.2), ("cc-by", 0.9), ("cc0", 1.0), ("mit", 1.0), ("apache", 1.0), ("bsd", 1.0),
    ("isc", 1.0), ("0bsd", 1.0), ("unlicense", 1.0), ("mpl", 0.7), ("lgpl", 0.6), ("agpl", 0.3), ("gpl", 0.4),
    ("reserved", 0.0),
)
UNKNOWN = 0.5
# Binding strength of the operators.
STRENGTH = {"with": 3, "and": 2, "or": 1}
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+:-]+)")


def freedom(identifier: str) -> float:
    return next((value for start, value in FREEDOM if identifier.startswith(start)), UNKNOWN)


def well_formed(text: str, start=0):
    """Tokens of the longest well-formed expression of ``text`` from ``start`` on, inside one line.

    Tokens are read one by one, up to the first that cannot follow, so a text with many
    expressions is read once. ``with`` takes one identifier, no bracket.
    """
    tokens, end, operand_next, opened = [], 0, True, 0
    while match := TOKEN.match(text, start):
        start = match.end()
        word = match[1].lower()
        if operand_next:
            if word == "(" and tokens[-1:] != ["with"]:
                opened += 1
            elif word in "()" or word in STRENGTH:
                break
            else:
                operand_next = False
        elif word == ")" and opened:
            opened -= 1
        elif word in STRENGTH:
            operand_next = True
        else:
            break
        tokens.append(word)
        if not opened and not operand_next:
            end = len(tokens)
    return tokens[:end]


def parse_expression(text: str, start=0):
    """The longest well-formed expression of ``text`` from ``start`` on, in postfix order.

    Shunting-yard over all its tokens: ``with`` binds before ``and``, ``and`` before ``or``.
    Returns an empty list if nothing is well formed.
    """
    output, operators = [], []
    for word in well_formed(text, start):
        if word == "(":
            operators.append(word)
        elif word == ")":
            while operators[-1] != "(":
                output.append(operators.pop())
            operators.pop()
        elif word in STRENGTH:
            while operators and operators[-1] != "(" and STRENGTH[operators[-1]] >= STRENGTH[word]:
                output.append(operators.pop())
            operators.append(word)
        else:
            output.append(word)
    return output + operators[::-1]


def evaluate(postfix):
    """Labels and freedom of an expression: a choice takes the freer side, a sum the less free."""
    stack = []
    for token in postfix:
        if token in STRENGTH:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(({f"{label}-with-{extra}" for label in left[0] for extra in right[0]}, left[1]))
            else:
                # The smaller set goes into the larger, so a long expression is not copied at every operator.
                small, large = sorted((left[0], right[0]), key=len)
                large |= small
                stack.append((large, (max if token == "or" else min)(left[1], right[1])))
        else:
            token = token.rstrip(".:+") if len(token.rstrip(".:+")) else token
            stack.append(({token}, freedom(token)))
    return stack[0] if stack else (set(), None)


class Scanner:
    def __init__(self):
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase in {**NOTICE_PHRASES, **BASE_PHRASES}:
            self.phrases.add_word(f" {phrase} ", phrase)
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: bytes):
        """Number of words, starts of base phrases, base labels, all labels and score of one text."""
        words = normal_words(text)
        line = b" " + b" ".join(words) + b" "
        # One character per byte, so that positions need no decoding.
        starts, base, labels, scores = [], set(), set(), []
        found = list(self.phrases.iter(line.decode("latin-1")))
        # Word numbers of the places: blanks before them, for all places at once.
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if found else []
        places = np.searchsorted(blanks, [end - len(phrase) - 1 for end, phrase in found]).tolist()
        for at, (_, phrase) in zip(places, found):
            if phrase in BASE_PHRASES:
                starts.append(at)
                base.add(BASE_PHRASES[phrase])
            label = NOTICE_PHRASES.get(phrase) or BASE_PHRASES[phrase]
            labels.add(label)
            scores.append(freedom(label))
        lowered = text.lower().decode("latin-1")
        for end, _ in self.tags.iter(lowered):
            named, value = evaluate(parse_expression(lowered, end + 1))
            if named:
                labels |= named
                scores.append(value)
        # The most binding notice decides; a text without a notice is unknown.
        return len(words), starts, base, labels | base, min(scores) if scores else UNKNOWN


_SCANNER = []


def license_scan(docs: DataFrame) -> DataFrame:
    """Licence notices of every document.

    ``n_base`` places of base phrases (overlapping ones count each), ``first_word`` and
    ``last_word`` their smallest and largest start, ``base_labels``; ``labels`` adds those
    of notice phrases and of identifier tags, whose expressions are parsed and evaluated.
    ``score``: how free the most binding notice leaves the text, 0.5 without one.

    A null text is empty; it has no labels (empty strings) and null positions. Repeated
    rows are scanned each, an empty table gives no rows, null ids and extra columns do not matter.
    """

    @F.pandas_udf(
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        out = []
        for text in texts:
            n, starts, base, labels, score = _SCANNER[0].scan(text or b"")
            out.append((
                n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), score))
        columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        return pd.DataFrame(out, columns=columns).astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scan(F.col("text").cast("binary")).alias("found")).select("doc_id", "found.*")
