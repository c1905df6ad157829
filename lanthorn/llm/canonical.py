"""Mapping freely entered names to a list of products by a prefix-filter set-similarity join.

A name is folded (markup, compatibility forms, look-alike letters, case, everything but letters and digits), stripped
of decoration and version, and read in every way that fits: a product word with a kind word before or behind it (whole,
abbreviated or translated), or the word alone. A reading is a text and a kind. The list gives reference texts the same
way: word and maker + word with the entry's kind, former names, the bare word of a maker's only product with that word.
Texts are compared as sets of bigrams and numbered letters through ``prefix_join`` within the same kind; candidates are
checked by their edit distance and the best is kept: fewest edits, then highest Jaccard, then smallest id.

No words are built in. ``learn`` takes the kind words from the last words of the list and their abbreviations and
translations, and the decorations of names, from what the entered names hold beside listed words: a text that stands
behind many different words whose products share one kind is another spelling of that kind (one word is enough for a
text of the kind's first letter and further letters of it in order), and a text that stands beside products of many
different makers is decoration.

Defined results: null and empty names, and names that reach no entry, get canon_id 0. A bare word that several entries
share gets 0. Names equal in writing are mapped once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanthorn.llm import prefix_join
from lanthorn.operators.skew import skew_join
from lanthorn.session import checkpoint, shuffle_partitions

#: Edits that any reference text tolerates.
MOST_EDITS = 2
#: A last word of the list is a kind word from so many entries on, and from a thousandth of them: 1000 kinds at most.
KIND_ENTRIES, KINDS_AT_MOST = 2, 1000
#: Different words behind which a text must stand to be a spelling, and the share of them that must have the kind.
SPELLING_WORDS, SPELLING_SHARE = 3, 0.8
#: Different makers beside whose products a text must stand to be decoration.
DECORATION_MAKERS = 3
#: Letters of the longest text that is learned, and of the shortest word it is learned from.
LONGEST_PART, SHORTEST_WORD = 24, 4
#: Latin letters for Cyrillic and Greek letters of the same shape.
LOOKALIKE = str.maketrans("авеёкмнорстухіѕјԁցһӏοαερτυνικ", "abeekmhopctyxisjdghloaeptuvik")
#: Marks that markup is written with; all others are dropped before it is decoded, since they may stand within it.
STRAY = re.compile(r"[^\w\s&;%#]|_")
VERSION = re.compile(r"\d+(?:(?:rc|sp|beta|alpha)\d*)*$")


@dataclass
class Lexicon:
    """Kind words by their spellings (each kind word is one of its own), and decorations before and behind a name."""

    spellings: dict[str, str] = field(default_factory=dict)
    before: tuple[str, ...] = ()
    behind: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        self.kinds = sorted(set(self.spellings.values()))
        self.lengths = sorted({len(s) for s in self.spellings})
        # kind words by themselves and by what is left of them without one letter
        self.slips: dict[str, list[str]] = defaultdict(list)
        for k in self.kinds:
            for v in {k, *(k[:i] + k[i + 1 :] for i in range(len(k)))}:
                self.slips[v].append(k)
        self.slip_lengths = sorted({n for k in self.kinds for n in (len(k) - 1, len(k), len(k) + 1)})


def fold(text: str | None) -> str:
    """Letters and digits of a name, folded."""
    if not text:
        return ""
    if text.isascii() and "&" not in text and "%" not in text:
        return "".join(c for c in text.lower() if c.isalnum())
    s = STRAY.sub("", unicodedata.normalize("NFKC", text)).lower()
    s = unicodedata.normalize("NFKC", unquote(html.unescape(s)))
    s = s.casefold().translate(LOOKALIKE)
    return "".join(c for c in s if c.isalnum())


def without_version(t: str) -> list[str]:
    """What is left of a folded name without a version at its end, in every way; nothing if it has none."""
    cut = VERSION.sub("", t)
    # a v before the number may belong to the word or to the version
    return [] if cut == t else [cut, cut.removesuffix("version"), cut.removesuffix("ver"), cut.removesuffix("v")]


def plain_forms(s: str, lexicon: Lexicon) -> list[str]:
    """The folded name and what is left of it without version and decoration, in every way."""
    forms = {s: None}
    todo = [s]
    while todo:
        t = todo.pop()
        less = without_version(t)
        less += [t.removesuffix(w) for w in lexicon.behind] + [t.removeprefix(w) for w in lexicon.before]
        for x in less:
            if x and x not in forms:
                forms[x] = None
                todo.append(x)
    return list(forms)


def slipped(piece: str, lexicon: Lexicon) -> list[str]:
    """Whole kind words at an edit distance of 1."""
    # an edit leaves the same letters on both sides once one is taken from each at most
    met = {k for v in (piece, *(piece[:i] + piece[i + 1 :] for i in range(len(piece)))) for k in lexicon.slips.get(v, ())}
    return [k for k in met if edits(piece, k, 1) == 1]


def readings(name: str | None, lexicon: Lexicon) -> list[tuple[str, str, int]]:
    """(text, kind, slips) in every way the name can be read; kind '' takes the text as a whole.

    A kind word stands behind the text, in any spelling, or whole before it; a whole kind word may hold one slip at any
    letter in both places.
    """
    s = fold(name)
    out: dict[tuple[str, str], int] = {}
    for t in plain_forms(s, lexicon) if s else ():
        out[t, ""] = 0
        for n in lexicon.lengths:
            if len(t) > n + 2:
                if kind := lexicon.spellings.get(t[-n:]):
                    out[t[:-n], kind] = 0
                if (kind := lexicon.spellings.get(t[:n])) == t[:n]:
                    out[t[n:], kind] = 0
        for n in lexicon.slip_lengths:
            if len(t) > n + 2:
                for text, piece in ((t[:-n], t[-n:]), (t[n:], t[:n])):
                    if piece in lexicon.spellings:
                        continue
                    for kind in slipped(piece, lexicon):
                        out.setdefault((text, kind), 1)
    return [(t, k, d) for (t, k), d in out.items()]


def tokens(text: str) -> set[str]:
    """Bigrams and numbered letters."""
    seen: dict[str, int] = defaultdict(int)
    out = {f"_{text[i : i + 2]}" for i in range(len(text) - 1)}
    for c in text:
        seen[c] += 1
        out.add(f"{c}{seen[c]}")
    return out


#: Tokens that one edit takes from a text at most (a letter and two bigrams, or the three bigrams of a swap); it brings no more.
EDIT_TOKENS = 3


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of letters that are or become neighbours; ``most`` + 1 for anything larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    big = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[big] * (len(b) + 2), [big, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, met = [big, i], 0
        for j, y in enumerate(b, 1):
            k = last.get(y, 0)
            swap = rows[k][met] + (i - k - 1) + 1 + (j - met - 1)
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swap))
            if x == y:
                met = j
        if min(row[1:]) > most + 1:
            return most + 1
        rows.append(row)
        last[x] = i
    return min(rows[-1][-1], most + 1)


def allowed(text: str) -> int:
    """Edits that a reference text tolerates."""
    return MOST_EDITS if len(text) >= 8 else 1 if len(text) >= 6 else 0


# --- the list and what is learned from it -----------------------------------------------------------------------------


def entries(products: DataFrame) -> tuple[DataFrame, list[str]]:
    """(canon_id, word, kind, maker, former) of the list, and its kind words."""

    @F.pandas_udf("string")
    def folded(s):
        import pandas as pd

        return pd.Series([fold(x) for x in s], dtype=object)

    @F.pandas_udf("array<string>")
    def folded_all(s):
        import pandas as pd

        return pd.Series([[y for x in (v if v is not None else ()) if (y := fold(x))] for v in s], dtype=object)

    name = F.trim(F.coalesce("canon_name", F.lit("")))
    split = products.select("canon_id", name.alias("name"), "vendor", "also_known_as")
    split = split.withColumn("last", F.when(F.instr("name", " ") > 0, folded(F.substring_index("name", " ", -1))).otherwise(""))
    total = split.count()
    often = split.where("last != ''").groupBy("last").count().where(F.col("count") >= max(KIND_ENTRIES, total / KINDS_AT_MOST))
    kinds = sorted(r["last"] for r in often.collect())  # KINDS_AT_MOST words
    kind = F.when(F.col("last").isin(kinds), F.col("last")).otherwise("") if kinds else F.lit("")
    head = F.expr("substring(name, 1, length(name) - length(substring_index(name, ' ', -1)))")
    out = split.withColumn("kind", kind).withColumn("word", folded(F.when(F.col("kind") != "", head).otherwise(F.col("name"))))
    return out.select("canon_id", "word", "kind", folded(F.coalesce("vendor", F.lit(""))).alias("maker"), folded_all("also_known_as").alias("former")), kinds


def between(name: str | None) -> list[tuple[str, str, bool]]:
    """(text, what stands beside it, whether behind it) of all runs of one to three pieces with others on both sides."""
    pieces = [x for p in re.split(r"[\W_]+", name or "") if (x := fold(p))]
    out = []
    for i in range(1, len(pieces) - 1):
        for j in range(i + 1, min(i + 4, len(pieces))):
            sides = ("".join(pieces[:i]), False), ("".join(pieces[j:]), True)
            out += [("".join(pieces[i:j]), part, behind) for part, behind in sides if len(part) <= LONGEST_PART]
    return out


def learn(names: DataFrame, listed: DataFrame, kinds: list[str]) -> Lexicon:
    """Spellings and decorations from all distinct ``names`` (name) against the entries of the list.

    Names are cut behind and before every listed word in an equi-join, at any letter, and on both sides of it between
    their pieces; only the learned texts reach the driver. A text that several kinds could claim goes to none.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n in b.column(0).to_pylist():
                s = fold(n)
                out += {s, *without_version(s)}
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["form"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for n in b.column(0).to_pylist() for x in between(n)]
            cols = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.string(), pa.bool_()))], names=["key", "part", "behind"])

    form = names.select("name").mapInArrow(forms, "form string").where(F.length("form") > SHORTEST_WORD)
    n = F.length("form")
    cut = form.select("form", n.alias("n"), F.explode(F.sequence(F.lit(1), n - 1)).alias("at"))
    head, tail = F.expr("substring(form, 1, at)"), F.expr("substring(form, at + 1)")
    behind = cut.where((F.col("at") >= SHORTEST_WORD) & (F.col("n") - F.col("at") <= LONGEST_PART)).select(head.alias("key"), tail.alias("part"), F.lit(True).alias("behind"))
    before = cut.where((F.col("n") - F.col("at") >= SHORTEST_WORD) & (F.col("at") <= LONGEST_PART)).select(tail.alias("key"), head.alias("part"), F.lit(False).alias("behind"))
    words = listed.where("word != '' and kind != ''").groupBy("word").agg(F.collect_set("kind").alias("kinds"), F.min("maker").alias("maker"))
    heads = words.select("word", "kinds", F.explode(F.array("word", F.concat("maker", "word"))).alias("key")).distinct()
    # words and names of the list are broadcast where their number is small
    few = F.broadcast if listed.count() <= prefix_join.RANKED else (lambda d: d)
    met = behind.drop("behind").join(few(heads), "key").select("part", "word", "kinds").distinct()
    counted = met.groupBy("part").agg(F.count("*").alias("words"))
    per = met.select("part", F.explode("kinds").alias("kind")).groupBy("part", "kind").agg(F.count("*").alias("n"))
    short = (F.length("part") >= 2) & (F.length("part") * 3 <= F.length("kind") * 2) & F.expr("kind rlike concat('^', regexp_replace(part, '([a-z])', '$1.*'))") & F.expr("part rlike '^[a-z]+$'")
    enough = (F.col("n") >= SPELLING_WORDS) | short
    pure = per.join(counted, "part").where(enough & (F.col("n") >= F.col("words") * SPELLING_SHARE))
    pure = pure.groupBy("part").agg(F.max_by("kind", "n").alias("kind"), F.count("*").alias("claims")).where("claims = 1")
    full = listed.where("word != ''").select(F.concat("word", "kind").alias("key"), "maker").where(F.length("key") > SHORTEST_WORD).distinct()
    around = names.select("name").mapInArrow(windows, "key string, part string, behind boolean")
    beside = behind.unionByName(before).unionByName(around).join(few(full), "key").select("part", "behind", "maker").distinct()
    decor = beside.groupBy("part", "behind").agg(F.count("*").alias("makers")).where(F.col("makers") >= DECORATION_MAKERS)
    found = pure.select("part", "kind", F.lit(True).alias("behind")).unionByName(decor.select("part", F.lit("").alias("kind"), "behind"))
    rows = found.collect()
    plain = re.compile(r"\D*")  # versions are read by a rule
    decorations = lambda side: tuple(sorted(r.part for r in rows if not r.kind and r.behind == side and plain.fullmatch(r.part)))
    spellings = {k: k for k in kinds} | {r.part: r.kind for r in rows if r.kind and plain.fullmatch(r.part) and r.part not in kinds}
    # a spelling with a decoration is no spelling of its own
    out = Lexicon({}, decorations(False), decorations(True))
    return Lexicon({s: k for s, k in spellings.items() if not any(s != f and f in spellings for f in plain_forms(s, out))}, out.before, out.behind)


def reference_rows(listed: DataFrame) -> DataFrame:
    """(text, kind, canon_id) of the list's entries; canon_id 0 where a bare word means none of several entries."""
    shared = listed.groupBy("word").agg(F.count_distinct("canon_id").alias("n"))
    d = listed.join(shared, "word")
    one = F.col("n") == 1
    text = lambda t, k: F.struct(t.alias("text"), k.alias("kind"), F.col("canon_id").cast("bigint").alias("canon_id"))
    both = F.array(F.col("word"), F.concat("maker", "word"))
    own = F.flatten(F.transform(both, lambda t: F.when(one, F.array(text(t, F.col("kind")), text(t, F.lit("")))).otherwise(F.array(text(t, F.col("kind"))))))
    former = F.flatten(F.transform("former", lambda a: F.array(*[text(t, k) for t in (a, F.concat("maker", a)) for k in (F.lit(""), F.col("kind"))])))
    # a bare word of several entries means none of them, nor any entry with a word like it
    none = F.when(one, F.array().cast("array<struct<text:string,kind:string,canon_id:bigint>>")).otherwise(F.array(F.struct(F.col("word").alias("text"), F.lit("").alias("kind"), F.lit(0).cast("bigint").alias("canon_id"))))
    return d.select(F.explode(F.concat(own, former, none)).alias("r")).select("r.*").where("text != ''").distinct()


# --- mapping ----------------------------------------------------------------------------------------------------------


def lexicon_of(names: DataFrame, products: DataFrame) -> Lexicon:
    """The lexicon that the distinct ``names`` and the list teach."""
    listed, kinds = entries(products)
    return learn(checkpoint(names), checkpoint(listed), kinds)


def map_names(names: DataFrame, products: DataFrame, ranked: int = prefix_join.RANKED) -> DataFrame:
    """(name, n, canon_id) of distinct names; ``names`` has a column ``name``, n is its number of rows.

    Up to ``ranked`` reference texts, the join's inverted index of their prefixes is broadcast and every name probes it;
    a longer list is joined by a shuffle of prefix tokens. Both give the same rows.
    """
    distinct = names.groupBy("name").agg(F.count("*").alias("n"))
    # few bytes, much work: an explicit number of partitions, which is not coalesced
    distinct = checkpoint(distinct.repartition(shuffle_partitions(names.sparkSession)))
    listed, kinds = entries(products)
    listed = checkpoint(listed)
    lexicon = learn(distinct, listed, kinds)
    refs = checkpoint(reference_rows(listed))
    mapped = probe_index(distinct, refs, lexicon) if refs.count() <= ranked else shuffle_join(distinct, refs, lexicon)
    return distinct.join(mapped, "name", "left").select("name", "n", F.coalesce("canon_id", F.lit(0)).cast("bigint").alias("canon_id"))


def probe_index(distinct: DataFrame, refs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(name, canon_id) of the names that reach an entry; at most RANKED reference texts."""
    rows = sorted((r.text, r.kind, r.canon_id) for r in refs.collect())
    given = distinct.sparkSession.sparkContext.broadcast((rows, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, lexicon = given.value
        index = prefix_join.Index([(tokens(t), k, EDIT_TOKENS * allowed(t)) for t, k, _ in rows])
        longest = max((len(t) for t, _, _ in rows), default=0) + MOST_EDITS
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                best = None
                for text, kind, slips in readings(name, lexicon):
                    if len(text) > longest:
                        continue
                    for i, jaccard in index.probe(tokens(text), kind, EDIT_TOKENS * MOST_EDITS):
                        ref, _, cid = rows[i]
                        d = edits(text, ref, allowed(ref))
                        if d <= allowed(ref) and d + slips <= MOST_EDITS and (best is None or (d + slips, -jaccard, cid) < best):
                            best = d + slips, -jaccard, cid
                if best:
                    out.append((name, best[2]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["name", "canon_id"])

    return distinct.select("name").mapInArrow(run, "name string, canon_id bigint")


def shuffle_join(distinct: DataFrame, refs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``probe_index`` for lists of any length: prefix tokens of both sides meet in an equi-join on (kind, token)."""
    side = "text string, kind string, slips int, key string, most int, size int, tokens array<bigint>"
    order = prefix_join.hash_order

    def row(text, kind, slips, key, most):
        toks = order(tokens(text))
        return text, kind, slips, key, most, len(toks), toks[: most + 1]

    def run(read):
        def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            for b in given:
                out = [row(*x) for v in zip(*(c.to_pylist() for c in b.columns)) for x in read(*v)]
                cols = zip(*out) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in side.split(", ")])

        return batches

    left = distinct.select("name").mapInArrow(run(lambda n: [(t, k, s, n, EDIT_TOKENS * MOST_EDITS) for t, k, s in readings(n, lexicon)]), side)
    right = refs.select("text", "kind", F.col("canon_id").cast("string")).mapInArrow(run(lambda t, k, c: [(t, k, 0, c, EDIT_TOKENS * allowed(t))]), side)
    pairs = prefix_join.overlap_join(left, right, "kind")

    def check(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            out = []
            for name, text, slips, ref, cid in zip(*(c.to_pylist() for c in b.columns)):
                d = edits(text, ref, allowed(ref))
                if d <= allowed(ref) and d + slips <= MOST_EDITS:
                    x, y = tokens(text), tokens(ref)
                    out.append((name, d + slips, -len(x & y) / len(x | y), int(cid)))
            cols = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.float64(), pa.int64()))], names=["name", "d", "j", "canon_id"])

    near = pairs.select(F.col("l.key").alias("name"), "l.text", "l.slips", F.col("r.text").alias("ref"), F.col("r.key").alias("cid"))
    good = near.mapInArrow(check, "name string, d int, j double, canon_id bigint")
    return good.groupBy("name").agg(F.min_by("canon_id", F.struct("d", "j", "canon_id")).alias("canon_id"))


def map_entries(entries: DataFrame, products: DataFrame, ranked: int = prefix_join.RANKED) -> DataFrame:
    """``entries`` (with columns name and row_id) with the canon_id each name means; null names get 0."""
    mapped = map_names(entries.where("name is not null"), products, ranked).where("canon_id != 0")
    # a name may hold a large part of all rows: its rows are spread over salts
    hit = skew_join(entries, mapped, "name", "n", F.xxhash64("row_id"), how="left")
    return hit.withColumn("canon_id", F.coalesce("canon_id", F.lit(0)).cast("bigint"))
