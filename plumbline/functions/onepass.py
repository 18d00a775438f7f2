"""All dimensions and all findings of a text in one pass over Arrow batches.

As columns, each rule is an expression of its own over the whole text, and the optimizer evaluates what stands under
higher-order functions row by row; measured, that was some 40 kB a second and core. Here a batch is taken apart once:
its words become numbers, what is known of a word is looked up by number, the words of a text tell which expressions can
match in it at all (gates.py), and the similarity of all sentences of a batch is one sort. Patterns without (?U) are
read with ASCII classes, as RE2 does; those of the rules with Unicode ones. The columns of functions/features.py define
the same numbers and the tests hold both against each other.

A null text counts as empty. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import features as f
from plumbline.functions.gates import FOLDED, Gates, longest, united
from plumbline.functions.text import ABBREVIATION, INNER_STOP, PIECE
from plumbline.rules import CODED, EM_DASH, LEXICON, PARTICIPLE, REWRITES, RULES, SEVERITIES, TRICOLON, Rule, pack
from plumbline.settings import DIMENSIONS, Settings

#: Characters of the texts that are taken apart at a time.
BLOCK = 1 << 20
#: Of an Arrow batch: a worker holds its texts several times over.
BATCH_BYTES = 4 << 20
#: Words that are remembered from one block to the next.
MOST_WORDS = 1 << 18
#: Lone surrogates, which no text holds: they stand after each sentence and each text of a block.
_SENTENCE, _TEXT = "\ud800", "\ud801"
_LEADER = "․"
_ascii = lambda p: re.compile(p, re.A)
#: A stop that ends no sentence: one inside a word or number, or after an abbreviation. It is looked for by its literal.
_GUARDED = _ascii(rf"\.(?:(?={INNER_STOP.removeprefix(r'\.')})|{'|'.join(rf'(?<=\b{x}\.)' for x in re.search(r'\((.*)\)', ABBREVIATION)[1].split('|'))})")
_PIECE = _ascii(PIECE)
_WORDS, _DIGIT = re.compile(rf"\w+|{_SENTENCE}|{_TEXT}"), re.compile(r"[0-9]")
_PLAIN = frozenset(re.search(r"\(\?:(.*)\)", f.PLAIN_VERBS.replace("(?i)", ""))[1].split("|"))
_ASCII_WORD = _ascii(r"\w+")
_SUPERLATIVES, _HEDGES, _CONCRETE, _NUMBER, _YEAR, _URL = (_ascii(p) for p in (f.SUPERLATIVES, f.HEDGES, f.CONCRETE, f.NUMBER, f.YEAR, f.URL))
_PROPER = _ascii(r"([^\x00-\x40\x5b-\x7f])(?<=[a-z,;:]\s.)(?=([^\x00-\x60\x7b-\x7f]))")
#: The hedges of one word, and the rest, with the words of which each match holds one.
_ONE_HEDGE = frozenset("about arguably around likely maybe nearly perhaps roughly".split())
_TWO_HEDGES, _HEDGE_PARTS = _ascii(r"(?i)\b(?:a (?:little|bit)|kind of|seems? to|sort of|tends? to)\b"), frozenset("little bit kind seem seems sort tend tends".split())
_SUPERLATIVE_STARTS = ("first", "largest", "last", "oldest", "only", "smallest", "second", "third")
_SUFFIXES = tuple(re.search(r"\(\?:(.*)\)", f.ABSTRACT)[1].split("|"))
_PARTICIPLE, _TRICOLON, _ABSTRACT = _ascii(f.PARTICIPLE), re.compile(f.TRICOLON), _ascii(f.ABSTRACT)
_ANALYSIS, _VAGUE, _NOT_LETTERS = frozenset(f.ANALYSIS), frozenset(f.VAGUE), re.compile("[^a-z]+")


def sentences(t: str) -> list[str]:
    """As functions.text.sentences."""
    t = _GUARDED.sub(_LEADER, t)
    return [x.replace(_LEADER, ".") for x in _PIECE.findall(t) if not x.isspace()]


def proper_nouns(t: str) -> int:
    """Capitalised words after a small letter or , ; : and white space."""
    found = _PROPER.findall(t)
    if t.isascii():
        return len(found)
    return sum((a.isascii() or unicodedata.category(a) == "Lu") and (b.isascii() or unicodedata.category(b) == "Ll") for a, b in found)


def vague(lead: str, clause: str) -> bool:
    return lead.lower() in _ANALYSIS or not _VAGUE.isdisjoint(_NOT_LETTERS.split(clause.lower()))


def abstract(words: tuple[str, ...]) -> bool:
    return sum(len(x) > 4 and _ABSTRACT.search(x.lower()) is not None for x in words) >= 2


#: What is known of a word, by its number: bits that say whether something can be there, and counts.
_ABSTRACT_WORD, _AND, _ENDS_THE, _ENDS_ONE, _OF, _STARTS_THE, _STARTS_SUPERLATIVE, _HEDGE_PART, _FIGURE = (np.uint16(1 << k) for k in range(9))
_SPECIAL = {"and": _AND, "of": _OF}


class Words:
    """Numbers of lower-case words, and what is known of each: flags, counts of plain verbs, hedges and years in it, its lexicon weight, and its gates' bits."""

    def __init__(self, gates: Gates, lexicon: dict[str, float]) -> None:
        self.gates, self.lexicon, self.size = gates, lexicon, 0
        self.number = defaultdict(count().__next__)
        self.flags, self.counts, self.weight = np.zeros(0, np.uint16), np.zeros((0, 3), np.int32), np.zeros(0)
        self.bits, self.long = np.zeros((0, gates.columns), np.uint64), np.zeros(0, bool)
        self.special = {*gates.words, *lexicon, *_PLAIN, *_ONE_HEDGE, *_HEDGE_PARTS, *_SPECIAL}  # not met yet
        self.numbers(_SENTENCE + _TEXT)
        self.flags[:2], self.long[:2] = 0, False

    def numbers(self, block: str) -> np.ndarray:
        """The words of a block in lower case, 0 for a sentence's end, 1 for a text's."""
        out = np.fromiter(map(self.number.__getitem__, _WORDS.findall(block)), np.int64)
        if len(self.number) > self.size:
            self._learn(list(islice(self.number, self.size, None)))
        return out

    def _learn(self, words: list[str]) -> None:
        """What is known of the next words."""
        at, self.size = self.size, len(self.number)
        if self.size > len(self.flags):
            for name in ("flags", "counts", "weight", "bits", "long"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros((2 * self.size - len(old), *old.shape[1:]), old.dtype)]))
        mark = lambda has, flag: np.where(np.fromiter(has, bool, len(words)), flag, np.uint16(0))
        flags = mark((len(w) > 4 and w.endswith(_SUFFIXES) for w in words), _ABSTRACT_WORD) | mark((w.endswith("the") for w in words), _ENDS_THE)
        flags |= mark((w.endswith("one") for w in words), _ENDS_ONE) | mark((w.startswith("the") for w in words), _STARTS_THE)
        flags |= mark((w.startswith(_SUPERLATIVE_STARTS) for w in words), _STARTS_SUPERLATIVE)
        self.flags[at : self.size] = flags
        self.long[at : self.size] = np.fromiter(map(len, words), np.int64, len(words)) > 1
        for w in [w for w in self.special if w in self.number]:
            self.special.discard(w)
            k = self.number[w]
            self.flags[k] |= _SPECIAL.get(w, np.uint16(0))
            self.weight[k] = self.lexicon.get(w, 0.0)
            if bits := self.gates.bits(w):
                self.bits[k] = bits
            self._parts(k, [w])
        for k, w in enumerate(words, at):
            if not w.isalpha() and _DIGIT.search(w):
                self.flags[k] |= _FIGURE
                if w.isascii():
                    self._parts(k, [w])
            if not w.isascii():
                self._parts(k, _ASCII_WORD.findall(w))

    def _parts(self, k: int, parts: list[str]) -> None:
        """What the words of ASCII characters in the k-th word count."""
        for part in parts:
            if part in _PLAIN:
                self.counts[k, 0] += 1
            elif part in _ONE_HEDGE:
                self.counts[k, 1] += 1
            elif part in _HEDGE_PARTS:
                self.flags[k] |= _HEDGE_PART
            elif len(part) == 4 and part[:2] in ("19", "20") and part.isdigit():
                self.counts[k, 2] += 1


class Remembered:
    """Words that are kept from block to block until there are too many."""

    def __init__(self, regexes: Iterable[str | None], lexicon: dict[str, float]) -> None:
        self.gates, self.lexicon = Gates(regexes), lexicon
        self.words = Words(self.gates, lexicon)

    def get(self) -> Words:
        if self.words.size > MOST_WORDS:
            self.words = Words(self.gates, self.lexicon)
        return self.words


def width(pattern: re.Pattern) -> int:
    """The most characters that a match has; 0 if there is no bound to speak of."""
    most = longest(pattern.pattern)
    return most if most < 1000 else 0


def begin(low: str, anchors: tuple[str, ...], most: int) -> int:
    """Where a search may begin: before the first anchor by a match's width; -1 if there is no anchor. low has its text's length."""
    if not anchors:
        return 0
    if not most:
        return 0 if any(a in low for a in anchors) else -1
    at = [x for a in anchors if (x := low.find(a)) >= 0]
    return max(0, min(at) - most) if at else -1


def folded(texts: list[str]) -> dict[int, str]:
    """The texts with characters that fold to ASCII letters: their words tell nothing, and lower case may change their length."""
    return {i: t for i, t in enumerate(texts) if not t.isascii() and any(c in t for c in FOLDED)}


#: Dimensions that need a text's sentences.
_BY_SENTENCE = frozenset(("cadence_sameness", "lexical_markers", "redundancy", "genericity"))


def triples(flags: np.ndarray) -> np.ndarray:
    """Where a word, another, "and" and a third follow one another and two of the three words at least are abstract."""
    at = np.flatnonzero(flags[2:-1] & _AND)
    long = (flags & _ABSTRACT_WORD > 0).astype(np.int8)
    return at[long[at] + long[at + 1] + long[at + 3] >= 2]


def similar_shares(sent: np.ndarray, word: np.ndarray, text_of: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """For each text, the share of consecutive sentences whose TF-IDF cosine reaches SIMILAR.

    Words are numbers below size, each with its sentence; sentences have their texts, and texts n sentences.
    """
    pairs = np.flatnonzero(sent[1:] == sent[:-1])
    term = np.r_[word, (word[pairs] + 1) * size + word[pairs + 1]]
    shift = max(1, len(text_of) - 1).bit_length()
    if (size * (size + 1)).bit_length() + shift > 63:  # a text of very many words
        term = np.unique(term, return_inverse=True)[1].ravel().astype(np.int64)
    key = np.sort(term << shift | np.r_[sent, sent[pairs]])  # a text's rows of a term follow one another
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    at, what = key & ((1 << shift) - 1), key >> shift
    text = text_of[at]
    new = np.ones(len(key), bool)
    new[1:] = (what[1:] != what[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    df = np.repeat(np.diff(np.r_[start, len(key)]), np.diff(np.r_[start, len(key)]))
    x = count * (np.log((1 + n[text]) / (1 + df)) + 1)
    norm = np.bincount(at, x * x, minlength=len(text_of))
    both = np.flatnonzero(~new[1:] & (at[1:] == at[:-1] + 1))
    dot = np.bincount(at[both], x[both] * x[both + 1], minlength=len(text_of))
    next_to = np.flatnonzero(text_of[1:] == text_of[:-1])
    scale = np.sqrt(norm[next_to] * norm[next_to + 1])
    near = np.where(scale > 0, dot[next_to] / np.where(scale > 0, scale, 1), 0) >= f.SIMILAR - 1e-12
    return np.bincount(text_of[next_to][near], minlength=len(n)) / np.maximum(n - 1, 1)


class Scanner:
    """Rules and weights of some settings, and the rules of a catalogue, compiled."""

    def __init__(self, settings: Settings, entries: Iterable[dict] = ()) -> None:
        self.settings = settings
        rules = {d: [*pack(d), *(x for x in settings.extra_rules if x.dimension == d)] for d in DIMENSIONS}
        compiled = lambda r: re.compile(r.regex, re.I | re.M)
        self.packs = {d: [(p := compiled(r), width(p), r.anchors, SEVERITIES[r.severity]) for r in rules[d]] for d in DIMENSIONS}
        self.lexicon = {t: w for c in LEXICON for t in c.terms if (w := c.weight_in(settings.profile)) > 0}
        self.entries = [(e, p, width(p) if p else 0) for e in entries for p in [compiled(e["rule"]) if e["rule"].regex else None]]
        self.remembered = Remembered([*(r.regex for d in DIMENSIONS for r in rules[d]), *(e["rule"].regex for e, _, _ in self.entries)], self.lexicon)

    def values(self, texts: list[str], words: list[int], wanted: tuple[str, ...], found: list[list] | None = None) -> dict[str, np.ndarray]:
        """Each wanted dimension of each text; to found, a list for each text, are added (start, end, i, n, note) of all matches of the catalogue, by rule and place."""
        out = {d: np.zeros(len(texts)) for d in wanted}
        if not texts:
            return out
        w, rated = np.array(words, float), np.array(words) > 0
        rate = lambda d, amount: np.where(rated, np.minimum(1.0, amount * 100.0 / np.where(rated, w, 1) / f.FULL[d]), 0.0)
        known = self.remembered.get()
        if _BY_SENTENCE.isdisjoint(wanted):
            number = known.numbers(_TEXT.join([*texts, ""]).lower())
        else:
            sents = list(map(sentences, texts))
            n_sents = np.array(list(map(len, sents)))
            number = known.numbers("".join([_SENTENCE.join([*s, ""]) + _TEXT for s in sents]).lower())
        ends = np.flatnonzero(number == 1)
        starts = np.r_[0, ends]  # the words of text i are among those from starts[i] to starts[i + 1]
        lows: list[str | None] = [None] * len(texts)

        def low(i: int) -> str:
            if lows[i] is None:
                lows[i] = texts[i].lower()
            return lows[i]

        flags, odd = known.flags[number], folded(texts)

        def texts_with(at: np.ndarray) -> list[int]:
            """The texts in which one of these words is, and the odd ones."""
            return sorted({*np.unique(np.searchsorted(ends, at)).tolist(), *odd})

        may = self.remembered.gates.may_match(united(known.bits[number], starts))
        may[:, list(odd)] = True
        matched: dict[str, list[int]] = {}  # the texts in which these expressions match
        if any(self.packs[d] for d in wanted):
            k = 0
            for d in DIMENSIONS:
                if d not in out:
                    k += len(self.packs[d])
                    continue
                for pattern, most, anchors, weight in self.packs[d]:
                    hit = matched[pattern.pattern] = []
                    for i in np.flatnonzero(may[k]).tolist():
                        at = begin(low(i), anchors, 0 if i in odd else most)
                        if at >= 0:
                            n = len(pattern.findall(texts[i], at))
                            if n:
                                hit.append(i)
                                out[d][i] += n * weight + (0.5 * (n - 1) if d == "formulaic_structure" else 0)
                    k += 1
            if "prompt_residue" in out:
                out["prompt_residue"] = np.minimum(1.0, out["prompt_residue"] / 4.0)
        threes = texts_with(triples(flags)) if "parallelism" in out or found is not None else []
        if "parallelism" in out:
            for i in threes:
                if " and " in texts[i]:
                    out["parallelism"][i] += SEVERITIES["low"] * sum(map(abstract, _TRICOLON.findall(texts[i])))
        for d in wanted:
            if d in f.FULL and self.packs[d]:
                out[d] = rate(d, out[d])
        if "cadence_sameness" in out:
            lengths = np.array([len(s.split()) for each in sents for s in each], float)
            at = 0
            for i, k in enumerate(n_sents.tolist()):
                if k >= 3 and (mean := sum(one := lengths[at : at + k].tolist()) / k) > 0:
                    out["cadence_sameness"][i] = max(0.0, 1 - (sum((x - mean) * (x - mean) for x in one) / k) ** 0.5 / mean / 0.6)
                at += k
        if "formatting_tells" in out:
            out["formatting_tells"][:] = 0
            for i, t in enumerate(texts):
                if t.isascii():
                    continue
                dashes, curly = t.count("—") + t.count("–"), sum(map(t.count, "“”‘’"))
                dash = min(1.0, dashes / (dashes + t.count(",")) / 0.25) if dashes >= 2 else 0.0
                quotes = curly / (curly + t.count('"') + t.count("'")) if curly >= 2 else 0.0
                out["formatting_tells"][i] = min(1.0, 0.6 * dash + 0.4 * quotes)
        counts = np.add.reduceat(np.r_[known.counts[number], np.zeros((1, 3), np.int32)], starts[:-1], axis=0)
        counts[starts[1:] == starts[:-1]] = 0
        if "human_writing_signals" in out or "genericity" in out:
            figures = np.zeros(len(texts), np.int64)
            for i in texts_with(np.flatnonzero(flags & _FIGURE)):
                figures[i] = len(_NUMBER.findall(texts[i]))
        if "human_writing_signals" in out:
            amount = counts[:, 0] + counts[:, 1] + figures.astype(float)
            two = np.flatnonzero(flags[1:] & np.where(flags[:-1] & _ENDS_THE, _STARTS_SUPERLATIVE, 0))
            three = np.flatnonzero((flags[:-2] & _ENDS_ONE > 0) & (flags[1:-1] & _OF > 0) & (flags[2:] & _STARTS_THE > 0))
            for i in texts_with(np.r_[two, three]):
                amount[i] += 1.5 * len(_SUPERLATIVES.findall(texts[i]))
            for i in texts_with(np.flatnonzero(flags & _HEDGE_PART)):
                if i in odd:
                    amount[i] += len(_HEDGES.findall(texts[i])) - counts[i, 1]
                else:
                    amount[i] += len(_TWO_HEDGES.findall(texts[i]))
            for i, t in enumerate(texts):
                if "$" in t:
                    amount[i] += len(_CONCRETE.findall(t)) - figures[i]
            out["human_writing_signals"] = rate("human_writing_signals", amount)
        if "lexical_markers" in out:
            amount, hits = np.zeros(len(texts)), np.flatnonzero(known.weight[number])
            each, of = known.weight[number[hits]].tolist(), np.searchsorted(np.flatnonzero(number == 0), hits)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            for i, a, b in zip(np.searchsorted(ends, hits[first]).tolist(), first.tolist(), [*first[1:].tolist(), len(of)]):
                amount[i] += sum(each[a:b]) + (0.5 if b - a >= 3 else 0.0)
            out["lexical_markers"] = rate("lexical_markers", amount)
        if "redundancy" in out:
            here = np.flatnonzero(known.long[number])
            out["redundancy"] = similar_shares(np.cumsum(number == 0)[here], number[here], np.repeat(np.arange(len(texts)), n_sents), n_sents, known.size)
        if "genericity" in out:
            years = counts[:, 2]
            for i, t in odd.items():
                years[i] = len(_YEAR.findall(t))
            items = np.array([proper_nouns(t) + (len(_URL.findall(t)) if "://" in t else 0) for t in texts]) + figures + years
            out["genericity"] = 1 - np.minimum(1.0, items / np.maximum(n_sents, 1) / 1.5)
        if "superficial_analysis" in out:
            amount = np.array([sum(vague(a, b) for a, b in _PARTICIPLE.findall(t)) for t in texts], float)
            out["superficial_analysis"] = rate("superficial_analysis", amount)
        if found is not None:
            for i, (entry, pattern, most) in enumerate(self.entries, len(may) - len(self.entries)):
                rule = entry["rule"]
                for k in threes if rule.rule_id == TRICOLON else matched[rule.regex] if rule.regex in matched else np.flatnonzero(may[i]).tolist():
                    at = begin(low(k), rule.anchors, 0 if k in odd else most)
                    if at >= 0:
                        places, note = _places(texts[k], entry, pattern, at)
                        found[k] += [(start, end, i - len(may) + len(self.entries), n, note) for n, (start, end) in enumerate(places)]
        return out


_scanners: dict[str, Scanner] = {}


def _scanner(settings: Settings, kind: str = "", entries: Iterable[dict] = ()) -> Scanner:
    key = repr((settings, kind))
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(settings, entries)
    return _scanners[key]


def _blocks(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of about BLOCK characters, or one text."""
    ends, i = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(text), 0), dtype=np.int64)), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, side="right")))
        yield i, j
        i = j


def bounded(df: DataFrame) -> DataFrame:
    """df; Arrow batches of its session hold BATCH_BYTES at most from now on, or one row, unless another bound than Spark's own is set."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


_PLACES = [("start", pa.int32()), ("end", pa.int32()), ("i", pa.int32()), ("n", pa.int32()), ("note", pa.string())]
_PLACES_SQL = "array<struct<start:int,end:int,i:int,n:int,note:string>>"


def _placed(found: list[list]) -> pa.Array:
    """Each text's matches as a list."""
    columns = list(zip(*(x for row in found for x in row))) or [[]] * len(_PLACES)
    values = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _PLACES)], fields=[pa.field(*x) for x in _PLACES])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), values)


def measure(settings: Settings, wanted: tuple[str, ...] = DIMENSIONS, places: bool = False) -> Column:
    """struct of the wanted dimensions, of a prepared row, and, if asked, of its ``located`` findings; never computed twice, for the optimizer leaves it where it is."""
    entries = catalogue(settings) if places else []

    def run(text: pa.Array, words: pa.Array) -> pa.Array:
        scanner, parts, found = _scanner(settings, "both" if places else "values", entries), [], []
        for i, j in _blocks(text):
            texts, rows = [t or "" for t in text.slice(i, j - i).to_pylist()], [[] for _ in range(j - i)] if places else None
            parts.append(scanner.values(texts, [w or 0 for w in words.slice(i, j - i).to_pylist()], wanted, rows))
            found += rows or []
        columns = [pa.array(np.concatenate([p[d] for p in parts]) if parts else [], pa.float64()) for d in wanted]
        return pa.StructArray.from_arrays([*columns, *([_placed(found)] if places else [])], names=[*wanted, *(["located"] if places else [])])

    run.__annotations__ = {"text": pa.Array, "words": pa.Array, "return": pa.Array}
    schema = "struct<" + ",".join([*(f"{d}:double" for d in wanted), *([f"located:{_PLACES_SQL}"] if places else [])]) + ">"
    return F.arrow_udf(run, schema).asNondeterministic()(F.col("t"), F.col("w").cast("int"))


def _order(dimension: str, k: int) -> int:
    """Findings that start together stand by dimension, then rule; rewrites come last."""
    return (DIMENSIONS.index(dimension) if dimension in DIMENSIONS else len(DIMENSIONS)) * 1000 + k


def lexicon_rules(settings: Settings) -> list[tuple[int, Rule]]:
    return [
        (_order("lexical_markers", k), Rule(c.rule_id, "lexical_markers", c.severity, rf"\b(?:{'|'.join(sorted(c.terms, key=lambda t: (-len(t), t)))})\b", c.terms, "word that polished text overuses"))
        for k, c in enumerate(LEXICON)
        if c.weight_in(settings.profile) > 0
    ]


def catalogue(settings: Settings, rewrites: bool = False) -> list[dict]:
    """Order, rule and what a finding says of each enabled rule; of the rewrites, if asked."""
    on = lambda dimension, rule_id: dimension not in settings.disabled_dimensions and rule_id not in settings.disabled_rules
    if rewrites:
        rows = [(_order("suggestion", k), r.rule, r.replacement, r.confidence) for k, r in enumerate(REWRITES) if r.rule.rule_id not in settings.disabled_rules]
    else:
        rules = [(_order(r.dimension, k), r) for k, r in enumerate((*RULES, *settings.extra_rules))] + lexicon_rules(settings)
        why = {EM_DASH: "", PARTICIPLE: "trailing clause of vague weight", TRICOLON: "three abstract items"}
        rules += [(_order(d, 900 if x == TRICOLON else 0), Rule(x, d, severity, "", (), why[x])) for x, (d, severity) in CODED.items()]
        rows = [(order, r, None, None) for order, r in rules if on(r.dimension, r.rule_id)]
    return [
        {"ord": order, "rule_id": r.rule_id, "dimension": r.dimension, "severity": r.severity if rewrites else settings.rule_severity.get(r.rule_id, r.severity), "explanation": r.explanation, "replacement": to, "confidence": sure, "rule": r}
        for order, r, to, sure in rows
    ]


def _places(t: str, entry: dict, pattern: re.Pattern | None, at: int) -> tuple[list[tuple[int, int]], str | None]:
    """Where a rule matches, no match of which begins before at, and what is said of it if that depends on the text."""
    rule_id = entry["rule_id"]
    if rule_id == EM_DASH:
        dashes = t.count("—") + t.count("–")
        if dashes < 2:
            return [], None
        at = min(x for x in (t.find("—"), t.find("–")) if x >= 0)
        return [(at, at + 1)], f"{dashes} dashes to {t.count(',')} commas"
    if rule_id == PARTICIPLE:
        return [m.span() for m in _PARTICIPLE.finditer(t) if vague(m[1], m[2])], None
    if rule_id == TRICOLON:
        return [m.span() for m in _TRICOLON.finditer(t) if abstract(m.groups())] if " and " in t else [], None
    return [m.span() for m in pattern.finditer(t, at)], None


def locate(settings: Settings, rewrites: bool = False) -> Column:
    """array<struct<start, end, i, n, note>> of all matches of the catalogue's i-th rule, n-th of its own, in cleaned offsets."""
    entries = catalogue(settings, rewrites)

    def run(text: pa.Array) -> pa.Array:
        scanner, found = _scanner(settings, "rewrites" if rewrites else "places", entries), []
        for i, j in _blocks(text):
            rows = [[] for _ in range(j - i)]
            scanner.values([t or "" for t in text.slice(i, j - i).to_pylist()], [0] * (j - i), (), rows)
            found += rows
        return _placed(found)

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _PLACES_SQL).asNondeterministic()(F.col("t"))
