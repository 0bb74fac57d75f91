"""The language of each document and of each passage of it.

Texts are cut into units of a sentence or less. A unit is the set of its character n-grams of several
lengths (a blended spectrum: presence, not counts), hashed to a fixed width. Its kernel with another unit is
the weighted number of n-grams both have, divided by the norms. The classifier is kernel ridge regression,
one language against the rest, on Nyström landmarks: ``score = K(unit, landmarks) @ alpha``. The kernel is a
scalar product of normalised presence vectors, so ``K @ alpha = X @ (Z.T @ alpha)``; scoring multiplies in
the second order, one matrix product per batch of units with as many columns as there are languages.

A document's units are then labelled together: the best path of languages, where each change of language
costs a penalty, so that names and single terms don't break a passage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages with their codes and names
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "it": ("it", "ita", "italian"),
    "zh": ("zh", "zho", "chi", "chinese"),
    "ja": ("ja", "jpn", "japanese"),
}

_TAG = regex.compile(r"<[a-zA-Z/!][^<>]*>")
#: a unit ends behind a full stop before space or wide characters, behind a wide full stop, and at the end of a line
_END = regex.compile(r"[.!?;](?=\s|[぀-鿿])|[。！？；]|\n|\Z")
#: short words in capitals among others, such as tickers, belong to no language
_CAPITALS = regex.compile(r"\b[A-Z][A-Z0-9.]{1,5}\b")
_WIDE = regex.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
#: letters of scripts in which none of the languages is written
_FOREIGN = regex.compile(r"[\u0370-\u1dff\uac00-\ud7af]")


def label_language(label: Column) -> Column:
    """The two-letter code a label names, whatever its case, region, length or English name; NULL if it names none of the languages."""
    base = F.regexp_extract(F.lower(F.btrim(label)), r"^([a-z]+)(?:[-_].*)?$", 1)
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in names for x in (name, code)])
    return F.try_element_at(known, F.nullif(base, F.lit("")))


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit (documents a language, units a document, landmarks) and of the labelling.

    ``least`` and ``least_wide`` are the characters from which a language counts; ``penalty`` is the cost of
    a change of language between sentences, ``penalty_inside`` within one.
    """

    documents: int = 160
    units: int = 6
    landmarks: int = 320
    orders: tuple[int, ...] = (1, 2, 3, 4)
    weights: tuple[float, ...] = (0.5, 1.0, 1.0, 1.0)
    scripts: float = 10.0
    width: int = 4096
    ridge: float = 0.05
    unit_chars: int = 90
    least: int = 80
    least_wide: int = 25
    penalty: float = 0.7
    penalty_inside: float = 0.8
    temperature: float = 0.12


def units(text: str, chars: int) -> list[tuple[int, int, bool]]:
    """(start, end, begins a sentence) of the units of a text; longer sentences are cut at spaces, without spaces after ``chars`` characters."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    wide = _WIDE.search(text) is not None
    found = []
    upto = 0
    for m in _END.finditer(text):
        end, behind = m.span()
        if end < behind and text[end] != "\n":
            # a stop that nothing precedes ends nothing
            if end == upto:
                continue
            end = behind
        start, upto = upto, behind
        while start < end and text[start].isspace():
            start += 1
        if start == end:
            continue
        first = True
        while end - start > chars / 2:
            # a wide character says as much as three others
            near = min(end, start + 2 * chars)
            limit = max(chars * (near - start) // (near - start + 2 * len(_WIDE.findall(text, start, near))), 1) if wide else chars
            if end - start <= limit * 1.5:
                break
            cut = text.find(" ", start + limit, min(end, start + limit * 2))
            cut = cut if cut > 0 else start + limit
            found.append((start, cut, first))
            start, first = cut, False
        found.append((start, end, first))
    return found


class Spectrum:
    """Presence vectors of n-grams of several orders, hashed to ``width`` columns each, and of the scripts of successive characters."""

    def __init__(self, settings: Settings):
        self.orders, self.width = settings.orders, settings.width
        self.root = np.sqrt(np.asarray(settings.weights, dtype=np.float32))
        self.script = np.float32(np.sqrt(settings.scripts))
        self.columns = len(self.orders) * self.width + 9
        self.prime = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]

    @staticmethod
    def _plain(text: str) -> str:
        plain = _CAPITALS.sub(" ", text)
        return plain if plain == text or any(c.islower() or c > "\u3000" for c in plain) else text

    @property
    def values(self) -> np.ndarray:
        """What a column holds where it is present."""
        return np.append(np.repeat(self.root, self.width), np.full(9, self.script, dtype=np.float32))

    def present(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of what each text holds, ordered by row, each pair once. A text without letters holds nothing. Digits count as spaces."""
        joined = "\x00".join(f" {' '.join(self._plain(t).lower().split())} " for t in texts)
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        code = np.where((code >= 48) & (code <= 57), np.uint64(32), code)
        ends = code == 0
        row = np.cumsum(ends) - ends
        # without a letter, spaces and punctuation say nothing
        letters = np.zeros(len(texts) + 1, dtype=bool)
        letters[row[(code > 64) & ~ends]] = True
        ends = ends | ~letters[row]
        base = row * self.columns
        held = []
        with np.errstate(over="ignore"):
            gram = np.zeros(len(code), dtype=np.uint64)
            bad = np.zeros(len(code), dtype=bool)
            done = 0
            for i, order in enumerate(self.orders):
                while done < order:
                    n = len(code) - done
                    if n <= 0:
                        break
                    gram, bad = gram[:n], bad[:n]
                    gram = (gram ^ code[done:]) * self.prime[done % len(self.prime)]
                    gram ^= gram >> np.uint64(29)
                    bad = bad | ends[done:]
                    done += 1
                keep = ~bad
                if order == 1:
                    keep &= code[: len(keep)] > 64
                column = ((gram * self.prime[-1]) >> np.uint64(40)) % np.uint64(self.width)
                held.append((base[: len(keep)] + column.astype(np.int64) + i * self.width)[keep])
        # Chinese characters, kana, and their neighbours of both kinds
        kind = np.where((code >= 0x3400) & (code <= 0x9FFF), 1, np.where((code >= 0x3041) & (code <= 0x30FA), 2, 0))
        pair = kind[:-1] * 3 + kind[1:]
        both = (pair > 3) & (pair != 6) & ~ends[:-1]
        held.append(base[:-1][both] + len(self.orders) * self.width + pair[both])
        held = np.sort(np.concatenate(held).astype(np.int32 if len(texts) * self.columns < 2**31 else np.int64))
        return np.divmod(held[np.append(True, held[1:] != held[:-1])[: len(held)]], self.columns)

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        """A normalised row per text, as a whole matrix; for the few units of a fit."""
        x = np.zeros((len(texts), self.columns), dtype=np.float32)
        row, column = self.present(texts)
        x[row, column] = self.values[column]
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.maximum(norm, 1e-9)[:, None]


@dataclass
class Classifier:
    """``weights``: the landmarks' presence vectors times their coefficients, a column per language."""

    languages: list[str]
    weights: np.ndarray
    settings: Settings

    def scores(self, texts: Sequence[str], spectrum: Spectrum, block: int = 128) -> np.ndarray:
        """``vectors(texts) @ weights``, of which only the columns that a text holds are touched, in blocks whose marks stay in the cache."""
        values = spectrum.values
        scaled, squares = self.weights * values[:, None], (values * values).astype(float)
        out = np.zeros((len(texts), self.weights.shape[1]), dtype=np.float32)
        for i in range(0, len(texts), block):
            part = texts[i : i + block]
            row, column = spectrum.present(part)
            if len(row):
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                norm = np.sqrt(np.add.reduceat(squares[column], starts))
                out[i + row[starts]] = np.add.reduceat(scaled[column], starts) / norm[:, None]
        return out


def fit(labelled: Sequence[tuple[str, str]], settings: Settings, rounds: int = 3, block: int = 256) -> Classifier:
    """From (language, text) units. Labels may be wrong: after each round but the last, units that the model gives to another language are left out."""
    rows = sorted(set(labelled))
    languages = sorted({language for language, _ in rows})
    spectrum = Spectrum(settings)
    if not rows:
        # nothing is known, so nothing gets a language
        return Classifier([], np.zeros((spectrum.columns, 0), dtype=np.float32), settings)
    rng = np.random.default_rng(7)
    y = np.array([languages.index(language) for language, _ in rows])
    # landmarks in equal numbers of each language, so that a rare one is as well described
    share = -(-settings.landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:share] for c in range(len(languages))])
    z = spectrum.vectors([rows[i][1] for i in chosen])
    kernel = np.concatenate([spectrum.vectors([t for _, t in rows[i : i + block]]) @ z.T for i in range(0, len(rows), block)]).astype(float)
    between = (z @ z.T).astype(float)
    kept = np.ones(len(rows), dtype=bool)
    for turn in range(rounds):
        k, target = kernel[kept], np.where(y[kept, None] == np.arange(len(languages)), 1.0, -1.0)
        # each language weighs the same, however many units it has
        weight = 1.0 / np.maximum(np.bincount(y[kept], minlength=len(languages)), 1)[y[kept]]
        weight *= kept.sum() / len(languages)
        system = (k * weight[:, None]).T @ k + settings.ridge * len(k) / 100 * between + 1e-6 * np.eye(len(z))
        alpha = np.linalg.solve(system, (k * weight[:, None]).T @ target)
        if turn < rounds - 1:
            right = (kernel @ alpha).argmax(axis=1) == y
            kept = right if right.any() else kept
    return Classifier(languages, (z.T @ alpha).astype(np.float32), settings)


def _best_path(scores: np.ndarray, size: np.ndarray, first: np.ndarray, settings: Settings) -> np.ndarray:
    """The language of each unit: the path with the greatest sum of scores, weighted by size, less the penalties of its changes."""
    gain = scores * np.minimum(size / settings.unit_chars, 1.5)[:, None]
    n, languages = gain.shape
    own = gain.argmax(axis=1)
    if (own == own[0]).all():
        return own
    total, back = gain[0].copy(), np.zeros((n, languages), dtype=np.int64)
    for i in range(1, n):
        best = int(total.argmax())
        change = total[best] - (settings.penalty if first[i] else settings.penalty_inside)
        back[i] = np.where(total >= change, np.arange(languages), best)
        total = np.maximum(total, change) + gain[i]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


Passage = tuple[int, int, str, float, int]  # start, end, language, confidence, characters


def passages(text: str, spans: Sequence[tuple[int, int, bool]], scores: np.ndarray, model: Classifier) -> list[Passage]:
    """Successive units of one language as passages with the confidence of their mean score."""
    if not len(spans):
        return []
    size = np.array([e - s for s, e, _ in spans], dtype=float)
    weight = size + 2.0 * np.array([len(_WIDE.findall(text, s, e)) for s, e, _ in spans]) if _WIDE.search(text) else size
    path = _best_path(scores, weight, np.array([f for *_, f in spans]), model.settings)
    found, i = [], 0
    while i < len(path):
        j = i
        while j + 1 < len(path) and path[j + 1] == path[i]:
            j += 1
        chars = size[i : j + 1].sum()
        mean = size[i : j + 1] @ scores[i : j + 1] / chars
        odds = np.exp((mean - mean.max()) / model.settings.temperature)
        found.append((spans[i][0], spans[j][1], model.languages[path[i]], float(odds[path[i]] / odds.sum()), int(chars)))
        i = j + 1
    return found


def counted_languages(found: Sequence[Passage], settings: Settings) -> dict[str, float]:
    """The languages that make up enough running text, or else the one with the most, with the confidence of their passages."""
    chars: dict[str, int] = {}
    trust: dict[str, float] = {}
    for *_, language, confidence, size in found:
        chars[language] = chars.get(language, 0) + size
        trust[language] = trust.get(language, 0.0) + confidence * size
    enough = [x for x, n in chars.items() if n >= (settings.least_wide if x in ("zh", "ja") else settings.least)]
    if not enough and chars:
        enough = [max(sorted(chars), key=chars.get)]
    return {x: trust[x] / max(chars[x], 1) for x in sorted(enough)}


def labelled_passages(texts: Iterable[str | None], model: Classifier, batch: int = 512) -> Iterator[list[Passage]]:
    """The passages of each text, in order. Units of many texts are scored in one product; a long text takes several."""
    spectrum = Spectrum(model.settings)
    waiting: list[tuple[str, list]] = []
    pending = 0

    def flush() -> Iterator[list[Passage]]:
        pieces = [t[s:e] for t, spans in waiting for s, e, _ in spans]
        blocks = [model.scores(pieces[i : i + batch], spectrum) for i in range(0, len(pieces), batch)]
        scores = np.concatenate(blocks) if blocks else np.zeros((0, len(model.languages)))
        at = 0
        for text, spans in waiting:
            own, at = scores[at : at + len(spans)], at + len(spans)
            lettered = np.abs(own).sum(axis=1) > 0
            if _FOREIGN.search(text):
                lettered &= [2 * len(_FOREIGN.findall(text, s, e)) <= sum(map(str.isalpha, text[s:e])) for s, e, _ in spans]
            yield passages(text, [x for x, ok in zip(spans, lettered, strict=True) if ok], own[lettered], model)

    for text in texts:
        waiting.append((text or "", units(text or "", model.settings.unit_chars) if model.languages else []))
        pending += len(waiting[-1][1])
        if pending >= batch:
            yield from flush()
            waiting, pending = [], 0
    yield from flush()


def sample_units(documents: DataFrame, document_id: str, text: str, label: str, settings: Settings) -> list[tuple[str, str]]:
    """(language, unit) of a bounded sample: about ``settings.documents`` of each label by the hash of their id, ``settings.units`` units of each."""
    known = documents.select(F.col(document_id).alias("_id"), F.col(text).alias("_text"), label_language(F.col(label)).alias("_label")).where(
        F.col("_label").isNotNull() & F.col("_text").isNotNull()
    )
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    parts = 1_000_000
    chance = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(parts, -(-settings.documents * parts // n)))])
    picked = known.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) < F.element_at(chance, F.col("_label"))).limit(settings.documents * len(NAMES) * 2)
    chars, most = settings.unit_chars, settings.units

    def cut(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            out = []
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pieces = [t[s:e] for s, e, _ in units(t, chars)]
                wide = k in ("zh", "ja")
                pieces = [p for p in pieces if len(p) >= (5 if wide else 14)]
                pieces.sort(key=lambda p: zlib.crc32(p.encode("utf-8", "replace")))
                out += [(k, p[: 4 * chars]) for p in pieces[:most]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([p for _, p in out], pa.string())], ["language", "unit"])

    return [(r[0], r[1]) for r in picked.select("_text", "_label").mapInArrow(cut, "language string, unit string").collect()]


def fit_documents(documents: DataFrame, document_id: str = "doc_id", text: str = "text", label: str = "lang", settings: Settings = Settings()) -> Classifier:
    """The classifier for documents with labels of which most are right; without any label it knows no language."""
    return fit(sample_units(documents, document_id, text, label, settings), settings)


def document_passages(documents: DataFrame, model: Classifier, document_id: str = "doc_id", text: str = "text", keep: Sequence[str] = (), detail: bool = True) -> DataFrame:
    """(document_id, keep..., passages, languages) for each row: passages with start, end, language, confidence and
    characters, and the languages that count with their confidence. NULL and empty texts, and those without
    letters, have neither; units written mostly in a script of none of the languages belong to no passage. Among
    languages of its own scripts the set is closed: the confidence tells how sure the choice is. Texts are read
    whole, in place. Without ``detail`` the passages are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [document_id, *keep]
    types = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept)
    if detail:
        schema += ", passages array<struct<start:int,end:int,language:string,confidence:double,chars:int>>"
    schema += ", languages map<string,double>"

    def label(batches):
        import pyarrow as pa

        part = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("chars", pa.int32())]))
        names = ("start", "end", "language", "confidence", "chars")
        model = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = b.slice(i, 256)
                found = list(labelled_passages(rows.column(len(kept)).to_pylist(), model))
                lists = [pa.array([[dict(zip(names, p, strict=True)) for p in own] for own in found], part)] if detail else []
                counted = pa.array([list(counted_languages(own, model.settings).items()) for own in found], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *lists, counted], [*kept, *(["passages"] if detail else []), "languages"])

    return documents.select(*kept, text).mapInArrow(label, schema)
