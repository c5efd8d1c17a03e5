"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Kinds in the order used for ties, and their patterns. Repetitions after
# which nothing has to follow are possessive, which matches the same and keeps no stack.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would also start where the run does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Parts of a text in which the field looks for spans.
DIGIT_ZONE = re.compile(r"[+(]{0,2}[0-9](?:[ ().:/+-]{0,2}[0-9])*+")
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
MAX_ATOMS = 14
AT_CHARS = 80
# Zones learned from, of each sort, and the passes over them.
ZONES = 400
PASSES = 4
MAX_ZONE_CHARS = 120


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def _digits(text):
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str):
    """``(start, end, kind)`` of the base patterns, by start and then kind."""
    spans, at, last = [], text.find("@"), 0
    while at >= 0:
        # The leftmost match before this sign starts where the run of local characters does.
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            spans.append((start, 0, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return [(start, end, KINDS[kind]) for start, kind, end in sorted(spans)]


def zones(text: str):
    """Parts of a whole text that can hold a span, as ``(start, end)``: digits with few
    characters between them, and what surrounds an at sign."""
    found, at = [], text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > max(0, at - AT_CHARS) and not text[start - 1].isspace():
            start -= 1
        while end < min(len(text), at + AT_CHARS) and not text[end].isspace():
            end += 1
        found.append((start, end))
        at = text.find("@", at + 1)
    found += [m.span() for m in DIGIT_ZONE.finditer(text)]
    merged = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP_SHAPE = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
PHONE_SHAPE = re.compile(r"(\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}")
GROUP = re.compile(r"[0-9]+")


def span_features(span: str, before: str, after: str):
    """Measures of a candidate as a whole; ``before`` and ``after`` are the characters beside it."""
    groups = GROUP.findall(span)
    n = sum(map(len, groups))
    at, letters = "@" in span, any(c.isalpha() for c in span)
    ip = IP_SHAPE.fullmatch(span) is not None
    card = 14 <= n <= 19 and not letters and not at
    plus = span[0] == "+"
    phone = 10 <= n <= 15 and plus and not letters
    shaped = PHONE_SHAPE.fullmatch(span) is not None
    joined = bool(before) and (before.isalnum() or before in "._%+-@(")
    goes_on = bool(after) and (after.isalnum() or after in "@-")
    return [
        1.0, at, at and EMAIL_SHAPE.fullmatch(span) is not None, at and span.count("@") > 1, letters and not at,
        ip, ip and all(int(g) <= 255 for g in groups), card, card and luhn("".join(groups)),
        card and set(span) <= set("0123456789 -"), plus, phone, phone and set(span) <= set("+0123456789 ().-"),
        shaped, shaped and 10 <= n <= 15, n < 7, n > 19, joined, goes_on, joined and at, goes_on and at,
        span[0] in " .-)/:" or span[-1] in " .-(/:+", len(groups) / 5, n / 20, not span[-1].isalnum(),
    ]


N_FEATURES = 25


class Lattice:
    """The candidates of one zone: single atoms outside spans, and whole spans."""

    def __init__(self, text, start, end):
        self.text = text
        self.bounds = [m.start() for m in ATOM.finditer(text, start, end)] + [end]
        self.n = len(self.bounds) - 1

    def candidates(self, j):
        """First atoms and features of the candidates that end before atom ``j``."""
        firsts, rows, text, end = [], [], self.text, self.bounds[j]
        if text[end - 1] in " (":
            return firsts, rows
        after = text[end] if end < len(text) else ""
        for i in range(max(0, j - MAX_ATOMS), j):
            start = self.bounds[i]
            if text[start] in " .-)/:":
                continue
            span = text[start:end]
            if GROUP.search(span) or "@" in span:
                firsts.append(i)
                rows.append(span_features(span, text[start - 1] if start else "", after))
        return firsts, rows

    def filled(self):
        """With all candidates at hand, for learning from a zone of bounded length."""
        self.ends, rows = [[]], []
        for j in range(1, self.n + 1):
            firsts, found = self.candidates(j)
            self.ends.append([(i, len(rows) + k) for k, i in enumerate(firsts)])
            rows += found
        self.rows = np.array(rows, float).reshape(-1, N_FEATURES)
        return self


def _logsum(values, axis):
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


class Field:
    """Weights of span features by kind, and of the step from one segment's kind to the next.

    Kind 0 is an atom outside spans. Segments of kinds 1 to 4 are whole candidates of at
    most ``MAX_ATOMS`` atoms; the dynamic programs run over all ways to cut a zone.
    """

    def __init__(self):
        k = len(KINDS) + 1
        self.outside, self.spans, self.steps = np.zeros(1), np.zeros((N_FEATURES, k - 1)), np.zeros((k, k))

    def _forward(self, lattice, scores):
        k = len(KINDS) + 1
        forward = np.full((lattice.n + 1, k), -np.inf)
        entry = np.full((lattice.n + 1, k), -np.inf)
        entry[0] = self.steps[0]
        for j in range(1, lattice.n + 1):
            forward[j, 0] = entry[j - 1, 0] + self.outside[0]
            if lattice.ends[j]:
                starts, rows = map(list, zip(*lattice.ends[j]))
                forward[j, 1:] = _logsum(entry[starts, 1:] + scores[rows], 0)
            entry[j] = _logsum(forward[j][:, None] + self.steps, 0)
        return forward, entry

    def _backward(self, lattice, scores):
        k = len(KINDS) + 1
        starting = [[] for _ in range(lattice.n + 1)]
        for j, ends in enumerate(lattice.ends):
            for i, row in ends:
                starting[i].append((j, row))
        after = np.full((lattice.n + 1, k), -np.inf)
        after[lattice.n] = 0.0
        for i in range(lattice.n - 1, -1, -1):
            begin = np.full(k, -np.inf)
            begin[0] = self.outside[0] + after[i + 1, 0]
            if starting[i]:
                ends, rows = map(list, zip(*starting[i]))
                begin[1:] = _logsum(scores[rows] + after[ends, 1:], 0)
            after[i] = _logsum(self.steps + begin[None, :], 1)
        return after

    def gradient(self, lattice, truth):
        """Gradient of the log-likelihood of ``truth``, a list of ``(first atom, end atom, kind)``."""
        scores = lattice.rows @ self.spans
        forward, entry = self._forward(lattice, scores)
        after = self._backward(lattice, scores)
        total = _logsum(forward[lattice.n][None, :], 1)[0]
        rows = {(i, j): row for j, ends in enumerate(lattice.ends) for i, row in ends}
        outside, spans, steps = 0.0, np.zeros_like(self.spans), np.zeros_like(self.steps)
        true_spans = {(i, j): k for i, j, k in truth if (i, j) in rows}
        covered = {a for i, j in true_spans for a in range(i, j)}
        kind, i = 0, 0
        begins = {i: (j, k) for (i, j), k in true_spans.items()}
        while i < lattice.n:
            j, now = begins.get(i, (i + 1, 0))
            steps[kind, now] += 1
            if now:
                spans[:, now - 1] += lattice.rows[rows[i, j]]
            kind, i = now, j
        outside += lattice.n - len(covered)
        with np.errstate(invalid="ignore"):
            for j in range(1, lattice.n + 1):
                outside -= np.exp(entry[j - 1, 0] + self.outside[0] + after[j, 0] - total)
                for i, row in lattice.ends[j]:
                    spans -= np.outer(lattice.rows[row], np.exp(entry[i, 1:] + scores[row] + after[j, 1:] - total))
            for i in range(lattice.n):
                begin = np.full(len(KINDS) + 1, -np.inf)
                begin[0] = self.outside[0] + after[i + 1, 0]
                here = [(j, row) for j in range(i + 1, lattice.n + 1) if (row := rows.get((i, j))) is not None]
                if here:
                    ends, chosen = map(list, zip(*here))
                    begin[1:] = _logsum(scores[chosen] + after[ends, 1:], 0)
                left = forward[i] if i else np.r_[0.0, np.full(len(KINDS), -np.inf)]
                steps -= np.exp(left[:, None] + self.steps + begin[None, :] - total)
        return np.array([outside]), spans, steps

    def fit(self, examples, passes=PASSES, rate=0.3, shrink=1e-4):
        """Adaptive gradient steps over ``(lattice, truth)`` examples, in the order given."""
        sums = [np.full_like(w, 1e-3) for w in (self.outside, self.spans, self.steps)]
        for _ in range(passes):
            for lattice, truth in examples:
                gradients = self.gradient(lattice, truth)
                for weights, total, slope in zip((self.outside, self.spans, self.steps), sums, gradients):
                    slope = slope - shrink * weights
                    total += slope * slope
                    weights += rate * slope / np.sqrt(total)
        return self

    def decode(self, lattice):
        """The best way to cut a zone, as ``(first atom, end atom, kind)`` of its spans.

        Candidates are scored where they end and dropped, so a zone of any length needs
        two small numbers for each atom and kind.
        """
        k = len(KINDS) + 1
        best = np.full((lattice.n + 1, k), -np.inf)
        begin, previous = np.zeros((lattice.n + 1, k), np.int64), np.zeros((lattice.n + 1, k), np.int8)
        best[0, 0] = 0.0
        for j in range(1, lattice.n + 1):
            before = best[j - 1] + self.steps[:, 0]
            best[j, 0] = before.max() + self.outside[0]
            begin[j, 0], previous[j, 0] = j - 1, before.argmax()
            firsts, rows = lattice.candidates(j)
            if firsts:
                reach = best[firsts][:, :, None] + self.steps[None, :, 1:]
                value = reach.max(axis=1) + np.array(rows, float) @ self.spans
                chosen = value.argmax(axis=0)
                at = np.arange(k - 1)
                best[j, 1:], begin[j, 1:] = value[chosen, at], np.array(firsts)[chosen]
                previous[j, 1:] = reach.argmax(axis=1)[chosen, at]
        found, j, kind = [], lattice.n, int(best[lattice.n].argmax())
        while j > 0:
            i, last = int(begin[j, kind]), int(previous[j, kind])
            if kind:
                found.append((i, j, kind))
            j, kind = i, last
        return found[::-1]

    def spans_in(self, text):
        """``(start, end, kind)`` of the spans found in a whole text."""
        out = []
        for start, end in zones(text):
            lattice = Lattice(text, start, end)
            out += [(lattice.bounds[i], lattice.bounds[j], KINDS[k - 1]) for i, j, k in self.decode(lattice)]
        return out


def _truth(lattice, spans):
    """Spans as atoms of the lattice; those that overlap an earlier one, or cut an atom, are left out."""
    at = {b: i for i, b in enumerate(lattice.bounds)}
    out, last = [], 0
    for start, end, kind in spans:
        if start in at and end in at and at[start] >= last and at[end] - at[start] <= MAX_ATOMS:
            out.append((at[start], at[end], KINDS.index(kind) + 1))
            last = at[end]
    return out


def examples(texts):
    """Zones with base spans as truth; and each phone number again without its country
    code, as a phone number with its area in brackets and as plain digits without."""
    out = []
    for text in texts:
        spans = base_spans(text)
        variants = [(text, spans)]
        bare = re.sub(r"\+[0-9]{1,3} ?(?=\()", "", text)
        if bare != text:
            phones = [(*m.span(), "phone") for m in PHONE_SHAPE.finditer(bare) if m[0][0] == "("]
            variants.append((bare, sorted(base_spans(bare) + phones)))
            plain = re.sub(r"\(([0-9]{2,4})\) ?", r"\1-", bare)
            variants.append((plain, base_spans(plain)))
        for variant, spans in variants:
            for start, end in zones(variant):
                lattice = Lattice(variant, start, end).filled()
                out.append((lattice, _truth(lattice, [s for s in spans if start <= s[0] and s[1] <= end])))
    return out


def fit(docs: DataFrame, n_zones=ZONES) -> Field:
    """Learn from at most ``n_zones`` zones that hold a base span and as many that do not.

    The zones with the smallest hashes are taken, each with a few characters beside it;
    longer ones than ``MAX_ZONE_CHARS`` are not learned from.
    """

    @F.pandas_udf("array<struct<zone:string,holds:boolean>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            text, rows = text or "", []
            spans = base_spans(text)
            for start, end in zones(text):
                if end - start <= MAX_ZONE_CHARS:
                    holds = any(s < end and start < e for s, e, _ in spans)
                    rows.append({"zone": text[max(0, start - 3):end + 3], "holds": holds})
            out.append(rows)
        return pd.Series(out)

    # One pass over the texts; the rank is limited inside every task before anything is shuffled.
    found = docs.select(F.explode(cut("text")).alias("z")).select("z.zone", "z.holds").distinct()
    rank = F.row_number().over(Window.partitionBy("holds").orderBy(F.xxhash64("zone"), "zone"))
    chosen = found.withColumn("rank", rank).filter(F.col("rank") <= n_zones).collect()
    texts = [r.zone for r in sorted(chosen, key=lambda r: (not r.holds, r["rank"]))]
    # Both sorts alternate in an order of their own.
    mixed = [texts[i] for i in np.random.default_rng(3).permutation(len(texts))]
    return Field().fit(examples(mixed))


def all_spans(text, field):
    """Base spans, and those of the field that touch none of them."""
    base = base_spans(text)
    order = {kind: i for i, kind in enumerate(KINDS)}
    more, at, reach = [], 0, 0
    # Both lists go by start: base spans that start before a span ends either end before it or touch it.
    for span in field.spans_in(text):
        while at < len(base) and base[at][0] < span[1]:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= span[0]:
            more.append(span)
    return base, sorted(base + more, key=lambda s: (s[0], order[s[2]], s[1]))


def _joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """All columns of ``docs`` and ``found``: counts of base spans, ``base``, ``spans`` and the ``redacted`` text."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)

    @F.pandas_udf(f"{counts}, base string, spans string, redacted string")
    def find(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            base, spans = all_spans(text or "", model.value)
            numbers = [sum(k == kind for _, _, k in base) for kind in KINDS]
            out.append((*numbers, _joined(base), _joined(spans), None if text is None else redact(text, spans)))
        return pd.DataFrame(out, columns=[*(f"n_{k}" for k in KINDS), "base", "spans", "redacted"])

    return docs.withColumn("found", find("text"))


def redact(text, spans):
    """``text`` with each span replaced by its kind; overlapping spans become one."""
    parts, last = [], 0
    for start, end, kind in spans:
        if start >= last:
            parts += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(parts) + text[last:]


def personal_data(docs: DataFrame, n_zones=ZONES) -> DataFrame:
    """``doc_id``, counts and digest of the base spans, and all ``spans``, of every document.

    Base patterns decide alone on base spans. The field scores whole candidate spans in
    every part of a text that has a digit or an at sign, and chooses boundaries and
    kinds jointly; what it finds apart from base spans is added.

    A null text is empty and has no spans. Repeated rows are searched each, an empty
    table gives no rows, null ids and extra columns do not matter. With nothing to learn
    from the field finds nothing certain and all weights are zero.
    """
    texts = docs.select("doc_id", "text")
    found = find_personal_data(texts, fit(texts, n_zones))
    return found.select(
        "doc_id", *[f"found.n_{kind}" for kind in KINDS], F.sha2("found.base", 256).alias("base_sha256"), "found.spans")


def without_personal_data(docs: DataFrame, n_zones=ZONES) -> DataFrame:
    """``docs`` with spans replaced by their kind; ``n_chars``, if there, follows the text.

    Null texts stay null, empty ones empty. Repeated rows, null ids and all other columns
    are kept as they are; an empty table gives no rows.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = find_personal_data(kept, fit(docs.select("text"), n_zones))
    text = F.col("found.redacted")
    replaced = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
