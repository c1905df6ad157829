"""Languages of documents and of their passages by compression.

Each language has a raw-content zstandard dictionary made of its prose. A block of prose is compressed with every
dictionary and gets the language of the smallest result; where the runner-up is too close the block is rejected and has
no language of its own. A document's main language is that of most of its prose.

The dictionaries are fitted on a bounded sample of labelled rows: for each language the ``SAMPLE`` documents with the
smallest hash of their id. Labels may be wrong and documents may mix languages, so only sentences enter whose pairs of
words are more frequent under their own label than under any other.

Defined results: texts without prose (null, empty, no sentences) have no language. A label counts by its language
whatever its form; labels that name no language count as missing. A rejected block takes part in no decision; if all
blocks of a document are rejected, the sum of their sizes decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanthorn.llm import latex_prose

#: Labelled documents per language that dictionaries are made of; with 8 languages at most 8 x SAMPLE texts are gathered.
SAMPLE = 120
DICTIONARY_BYTES = 1 << 14
LEVEL = 1
#: Least margin of the runner-up, as a share of the smallest size.
MARGIN = 0.02
#: Letters that a block needs to count as prose.
LETTERS = 12
#: Languages and the forms of their labels (fixed values: ISO 639 codes and names).
LANGUAGES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castilian", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish"],
    "ru": ["ru", "rus", "russian", "русский"],
}


def label_column(c):
    """Code of the language that a label names, null if none of LANGUAGES."""
    first = F.lower(F.regexp_extract(F.trim(c), r"^([^-_\s(,;/]+)", 1))
    pairs = [F.lit(x) for code, forms in LANGUAGES.items() for f in forms for x in (f, code)]
    return F.try_element_at(F.create_map(*pairs), first)


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


class Judge:
    """Compressors of all languages."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.langs = list(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compress = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode("utf-8", "surrogatepass")
        return [len(c(data)) for c in self.compress]

    def decide(self, sizes: list[int]) -> tuple[str, float]:
        """(language, confidence): confidence is the share of the runner-up's size that the smallest saves."""
        best, second = sorted(range(len(sizes)), key=sizes.__getitem__)[:2]
        return self.langs[best], 1 - sizes[best] / sizes[second]


def prose_blocks(text: str | None, accents) -> list[tuple[int, str]]:
    """(block_no, prose) of the blocks that hold prose."""
    return [(i, b) for i, b in enumerate(latex_prose.blocks(text, accents), 1) if len(b) >= LETTERS and sum(map(str.isalpha, b)) >= LETTERS]


def judge_document(text: str | None, judge: Judge, accents, margin: float = MARGIN) -> tuple[str | None, float, list[tuple[int, str, float]]]:
    """(main language, confidence, [(block_no, language, confidence)]) of a text; (None, 0, []) without prose.

    A block's confidence is its margin. A document's is the margin of all of its prose: letters of blocks in its language
    count with their margin, those of rejected blocks and of blocks in another language with 0.
    """
    weight: dict[str, int] = defaultdict(int)
    margins: dict[str, float] = defaultdict(float)
    found, all_sizes, chars = [], None, 0
    for no, prose in prose_blocks(text, accents):
        sizes = judge.sizes(prose)
        lang, conf = judge.decide(sizes)
        chars += len(prose)
        all_sizes = sizes if all_sizes is None else [a + b for a, b in zip(all_sizes, sizes)]
        if conf >= margin:
            weight[lang] += len(prose)
            margins[lang] += len(prose) * conf
            found.append((no, lang, conf))
    if all_sizes is None:
        return None, 0.0, []
    if not weight:
        lang, conf = judge.decide(all_sizes)
        return lang, conf, []
    main = max(weight, key=lambda k: (weight[k], k))
    return main, margins[main] / chars, found


def sample_prose(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """{language: prose of its sampled documents} by label; ``docs`` has doc_id, lang and text."""
    labelled = docs.select("doc_id", label_column(F.col("lang")).alias("label")).where("label is not null and doc_id is not null")
    # smallest hashes per language: each task keeps its own smallest first (rank limit pushed below the shuffle)
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    chosen = labelled.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("doc_id", "label")
    rows = chosen.collect()  # at most 8 x sample ids
    by_id = {r.doc_id: r.label for r in rows}
    texts = docs.where(F.col("doc_id").isin(list(by_id))).select("doc_id", "text").limit(4 * len(by_id) + 1) if by_id else None
    out: dict[str, list[str]] = {k: [] for k in LANGUAGES}
    accents = latex_prose.Accents()
    for r in sorted(texts.collect(), key=lambda r: r.doc_id) if texts is not None else ():
        prose = " ".join(b for _, b in prose_blocks(r.text, accents))
        if prose:
            out[by_id[r.doc_id]].append(prose)
    return out


def grams(sentence: str) -> list[tuple[str, str]]:
    words = [w for w in re.split(r"[^\w'-]+", sentence) if w]
    return list(zip(words, words[1:])) or [(w, "") for w in words]


def own_sentences(prose: dict[str, list[str]]) -> dict[str, list[list[str]]]:
    """Sentences of each language's documents that are in that language.

    A pair of words belongs to the language in whose documents it is most frequent (share of documents), so passages in
    another language and documents with a wrong label lose against the documents that rightly hold the same words.
    """
    docs = {k: [[s for s in _SENTENCE.split(p.lower()) if s] for p in v] for k, v in prose.items()}
    share: dict[tuple[str, str], dict[str, float]] = defaultdict(dict)
    for k, texts in docs.items():
        count = Counter(g for d in texts for g in {g for s in d for g in grams(s)})
        for g, n in count.items():
            share[g][k] = n / len(texts)
    owner = {g: max(by, key=lambda k: (by[k], k)) for g, by in share.items()}

    def own(s: str, k: str) -> bool:
        gs = grams(s)
        return sum(owner[g] == k for g in gs) * 2 > len(gs)

    return {k: [[s for s in d if own(s, k)] for d in texts] for k, texts in docs.items()}


def dictionary(sentences: list[list[str]], size: int = DICTIONARY_BYTES) -> bytes:
    """Raw content of a dictionary: sentences that bring many unseen pairs of words, taken in turn from all documents."""
    seen: set[tuple[str, str]] = set()
    late: list[str] = []
    parts: list[str] = []
    total = 0
    for k in range(max(map(len, sentences), default=0)):
        for doc in sentences:
            if k < len(doc):
                gs = set(grams(doc[k]))
                if len(gs - seen) * 2 >= max(1, len(gs)):
                    seen |= gs
                    parts.append(doc[k])
                    total += len(doc[k].encode()) + 1
                else:
                    late.append(doc[k])
        if total >= size:
            break
    for s in late:
        if total >= size:
            break
        parts.append(s)
        total += len(s.encode()) + 1
    return " ".join(parts).encode("utf-8", "surrogatepass")[-size:]


def fit(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries of all languages that have labelled prose."""
    return fit_prose(sample_prose(docs, sample), size)


def fit_prose(prose: dict[str, list[str]], size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    made = {k: dictionary(v, size) for k, v in own_sentences({k: v for k, v in prose.items() if v}).items()}
    return {k: d for k, d in made.items() if len(d) >= 8}


def languages(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, label, main, confidence, passages) of every row; main is null without prose.

    passages: array of (block_no, lang, confidence) of the blocks in another language than the main one.
    """
    given = docs.sparkSession.sparkContext.broadcast(dictionaries)  # 8 x DICTIONARY_BYTES
    src = docs.select("doc_id", label_column(F.col("lang")).alias("label"), F.col("text").cast("string").alias("text"))
    item = pa.struct([("block_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(given.value) if len(given.value) > 1 else None
        only = next(iter(given.value), None)
        accents = latex_prose.Accents()
        for b in batches:
            main, conf, parts = [], [], []
            for text in b.column(2).to_pylist():
                if judge is None:
                    m, c, found = (only if prose_blocks(text, accents) else None), 0.0, []
                else:
                    m, c, found = judge_document(text, judge, accents, margin)
                main.append(m)
                conf.append(c if m else None)
                parts.append([{"block_no": n, "lang": x, "confidence": y} for n, x, y in found if x != m])
            cols = [b.column(0), b.column(1), pa.array(main, pa.string()), pa.array(conf, pa.float64()), pa.array(parts, pa.list_(item))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "label", "main", "confidence", "passages"])

    doc = dict(src.dtypes)["doc_id"]
    schema = f"doc_id {doc}, label string, main string, confidence double, passages array<struct<block_no:int,lang:string,confidence:double>>"
    return src.mapInArrow(run, schema)
