"""Matching two catalogues without a shared id by a label model.

Both sides become evidence records: product words, kind, maker, addresses and icon hashes, taken from free-entered
fields. Candidate pairs share a blocking key (a word, a word with one or two letters left out, an address, a rare icon hash). Matching
functions vote on each candidate: agree, disagree or abstain. A generative model of the votes is fitted without labels by
expectation maximisation: each function has its rates of votes among matches and among others; functions whose votes
stay dependent given the class are modelled jointly, so that correlated functions do not count twice. The posterior of a
match is the confidence, and it alone decides: no rule stands behind it.

Scale: votes have few values, so only the counts of vote patterns (at most 3^7) reach the driver and the fitted
posteriors go back as a table of that size; candidates themselves never leave the executors. Rows that agree in all
evidence are one class, matched once and expanded at the end. A blocking key held by many classes is joined in blocks
of bounded size, all of them: its pairs are as many as the classes of both sides give.

Kind words and their spellings come from a ``canonical.Lexicon``. A word that stands with many different makers is a
second name (suite, core and the like) and no product word; these are counted, not listed.

Defined results: nulls and empty texts are no evidence. A record without any blocking key has no candidates. Rows
entered several times are all linked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanthorn.llm import canonical
from lanthorn.operators.skew import skew_join
from lanthorn.session import checkpoint, few

#: Different makers, and the share of all makers, with which a word must stand to be a second name that says nothing about
#: the product.
GENERIC_MAKERS, GENERIC_SHARE = 8, 0.01
#: An icon hash seen with more than this many hosts is a stock icon.
STOCK_HOSTS = 3
VOTERS = ("word", "product", "maker", "address", "icon", "kind", "path")
EVIDENCE = "word string, kind string, product string, maker string, addresses array<string>, paths array<string>, icons array<bigint>"
#: Share of matches in which a function votes against, where that is known beforehand: makers are folded, so two
#: spellings of one maker hardly differ, while namesakes of other makers agree in everything else.
KNOWN_ERRORS = {"maker": 1e-4}


def icon(text: str | None) -> int | None:
    """A favicon hash however it is spelt (decimal, unsigned, hexadecimal), as signed 32-bit number."""
    s = re.sub(r"[^0-9a-fx+-]", "", (text or "").strip().lower())
    try:
        n = int(s, 16) if s.lstrip("+-").startswith("0x") else int(s)
    except ValueError:
        return None
    n &= 0xFFFFFFFF
    return n - (1 << 32) if n >= 1 << 31 else n


def address(url: str | None) -> tuple[str, str] | None:
    """(host without www, first path step) of an address in any writing."""
    s = (url or "").strip().lower()
    s = re.sub(r"^[a-z][a-z0-9+.-]*:", "", s).lstrip("/")
    host, _, rest = s.partition("/")
    host = re.split(r"[?#:]", host)[0].removeprefix("www.")
    if "." not in host:
        return None
    step = re.split(r"[/?#]", rest)[0]
    return host, "" if "." in step else step


def split_name(name: str | None, lexicon: canonical.Lexicon) -> tuple[str, str]:
    """(text without the kind word, kind) of a free-entered product name: the longest kind word, behind before in front."""
    s = canonical.fold(name)
    front = behind = (s, "")
    for t in canonical.plain_forms(s, lexicon) if s else ():
        for n in lexicon.lengths:
            if len(t) > n + 2:
                if (k := lexicon.spellings.get(t[-n:])) and (not behind[1] or len(t) - n < len(behind[0])):
                    behind = t[:-n], k
                if (k := lexicon.spellings.get(t[:n])) == t[:n] and not front[1]:
                    front = t[n:], k
    return behind if behind[1] else front


def deletions(word: str) -> list[str]:
    """The word and its variants with as many letters left out as ``near`` allows edits: words it calls near share one."""
    out = {word: None}
    for _ in range(2 if len(word) >= 7 else 1 if len(word) >= 5 else 0):
        out |= dict.fromkeys(w[:i] + w[i + 1 :] for w in list(out) for i in range(len(w)))
    return list(out)


def evidence(name: str | None, maker: str | None, product: str | None, urls: list[str | None], icons: list[int], lexicon: canonical.Lexicon) -> tuple:
    """An EVIDENCE row."""
    maker = canonical.fold(re.sub(r"_project$", "", (maker or "").strip().lower()))
    word, kind = split_name(name, lexicon)
    prod, pkind = split_name(product, lexicon)
    kind = kind or pkind
    if maker and word.startswith(maker) and len(word) > len(maker):
        word = word.removeprefix(maker)
    elif maker and word == maker:
        word = ""
    pieces = [x for x in (canonical.fold(p) for p in re.split(r"[\W_]+", name or "")) if x]
    if not maker and len(pieces) == 3 and pieces[2] in lexicon.spellings and len(pieces[0]) >= 4 and len(pieces[1]) >= 5:
        maker, word = pieces[0], pieces[1]  # maker, word and kind stand apart
    spots = [a for u in urls if (a := address(u))]
    full, paths = [], []
    for host, step in spots:
        parts = host.split(".")
        root = ".".join(parts[-2:])
        label = canonical.fold(parts[-2])
        if step and not step.isdigit():
            full.append(f"{root}/{step}")
            paths.append(canonical.fold(step))
        elif not step:
            full.append(root)
            paths.append(label)
    return word, kind, prod, maker, sorted(set(full)), sorted({p for p in paths if p}), sorted(set(icons))


def blocking_keys(word: str, product: str, addresses: list[str], paths: list[str], icons: list[int]) -> set[str]:
    words = {w for w in (word, product) if w}
    keys = {f"d:{d}" for w in words for d in deletions(w)} | {f"w:{w}" for w in words | set(paths)}
    return keys | {f"a:{a}" for a in addresses} | {f"i:{i}" for i in icons}


def with_evidence(df: DataFrame, parse, lexicon: canonical.Lexicon) -> DataFrame:
    """(id, EVIDENCE) of a table whose first column is the id; ``parse`` turns the other columns into a row."""
    given = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, texts = pa.string(), pa.list_(pa.string())
        kinds = (text, text, text, text, texts, texts, pa.list_(pa.int64()))
        names = [c.split()[0] for c in EVIDENCE.split(", ")]
        words = given.value
        for b in batches:
            rows = [parse(*v, words) for v in zip(*(c.to_pylist() for c in b.columns[1:]))]
            cols = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], names=["id", *names])

    first = df.columns[0]
    return df.withColumnRenamed(first, "id").withColumn("id", F.col("id").cast("bigint")).mapInArrow(run, "id bigint, " + EVIDENCE)


def without_generic(left: DataFrame, right: DataFrame, makers: int = GENERIC_MAKERS) -> tuple[DataFrame, DataFrame]:
    """Both evidence tables without words that say nothing about the product.

    A word with many makers, over both sides, is generic, and so is a maker's name with such a word behind it where the
    row names no maker.
    """
    pairs = left.select("word", "maker").unionByName(right.select("word", "maker")).where("word != '' and maker != ''").distinct()
    most = max(makers, GENERIC_SHARE * pairs.agg(F.count_distinct("maker")).first()[0])
    generic = checkpoint(pairs.groupBy("word").agg(F.count("*").alias("makers")).where(F.col("makers") >= most).select("word"))
    if not generic.head(1):
        return left, right
    # a word needs a hundredth of all makers, so a maker has a hundred second names at most
    joined = pairs.select("maker").distinct().join(few(generic.withColumnRenamed("word", "second")))
    bare = generic.select("word", F.lit("").alias("of")).unionByName(joined.select(F.concat("maker", "second").alias("word"), F.lit("none").alias("of")))
    bare = few(checkpoint(bare.groupBy("word").agg(F.min("of").alias("of"))))

    def clean(d: DataFrame) -> DataFrame:
        met = d.join(bare, "word", "left")
        drop = (F.col("of") == "") | ((F.col("of") == "none") & (F.col("maker") == ""))
        return met.withColumn("word", F.when(drop, "").otherwise(F.col("word"))).select(*d.columns)

    return clean(left), clean(right)


def native_evidence(name, maker, product, links, icons, lexicon) -> tuple:
    return evidence(name, maker, product, list(links or ()), [i for x in icons or () if (i := icon(x)) is not None], lexicon)


def app_evidence(app, cpe, website, icons, lexicon) -> tuple:
    """Evidence of an application row: its maker and product stand in the cpe, in either notation."""
    parts = [p.replace("\\", "") for p in re.split(r"(?<!\\):", (cpe or "").strip().lower())]
    at = 3 if parts[:2] == ["cpe", "2.3"] else 2
    maker, product = (parts + [""] * 6)[at : at + 2]
    return evidence(app, maker.strip("*-"), product.strip("*-"), [website], list(icons or ()), lexicon)


def spots(df: DataFrame, key: str, url: str) -> DataFrame:
    """(key, host, step) of the rows whose url can be read; an icon hash as key becomes its number."""
    kind = "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = icon(k) if isinstance(k, str) else k
                if k is not None and (a := address(u)):
                    out.append((k, *a))
            cols = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=[key, "host", "step"])

    return df.select(key, url).mapInArrow(run, f"{key} {kind}, host string, step string")


def app_icons(apps: DataFrame, favicons: DataFrame) -> DataFrame:
    """(app_id, icons): hashes seen at the address of an application's website, stock icons left out."""
    seen = spots(favicons.withColumnRenamed("mmh3", "icon"), "icon", "url").distinct()
    hosts = seen.groupBy("icon").agg(F.count_distinct("host").alias("hosts")).where(F.col("hosts") <= STOCK_HOSTS)
    seen = seen.join(hosts.select("icon"), "icon")
    return spots(apps, "app_id", "website").join(seen, ["host", "step"]).groupBy("app_id").agg(F.collect_set("icon").alias("icons"))


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, EVIDENCE, n) of the records that agree in all evidence, and (id, rep) of all records."""
    cols = [c for c in records.columns if c != "id"]
    h = checkpoint(records.withColumn("h", F.unhex(F.md5(F.to_json(F.struct(*cols))))))
    reps = h.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in cols])
    member = skew_join(h.select("id", "h"), reps.select("h", "rep", F.col("n").alias("_w")), "h", "_w", F.col("id"))
    return reps.drop("h"), member.select("id", "rep")


def candidates(left: DataFrame, right: DataFrame, max_block: int = 1000) -> DataFrame:
    """(left_rep, right_rep) pairs that share a blocking key.

    Deletion variants meet whole words and each other. A key with more than ``max_block`` squared pairs is joined in
    blocks: each side is cut into parts of about ``max_block`` classes and every part meets all parts of the other side,
    so the work of a key spreads over tasks and the pairs do not depend on ``max_block``. Keys travel as 64-bit hashes;
    the votes see to pairs that only share a hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, keys = [], []
            for i, v in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                own = blocking_keys(*v)
                keys += own
                idx += [i] * len(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(idx, pa.int32())), pa.array(keys, pa.string())], names=["rep", "key"])

    def keyed(df, rep):
        out = df.select("rep", "word", "product", "addresses", "paths", "icons").mapInArrow(run, "rep bigint, key string")
        return out.select(F.col("rep").alias(rep), F.xxhash64("key").alias("key"))

    lk, rk = keyed(left, "left_rep"), keyed(right, "right_rep")
    sides = lk.select("key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(rk.select("key", F.lit(0).alias("l"), F.lit(1).alias("r")))
    parts = lambda c: F.ceil(F.col(c) / F.lit(max_block)).cast("int")
    hot = sides.groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where(F.col("l") * F.col("r") > max_block * max_block)
    hot = checkpoint(hot.select("key", parts("l").alias("l_parts"), parts("r").alias("r_parts")))
    n_hot = hot.count()

    def spread(df, rep, own, other):
        if not n_hot:
            return df.select(rep, "key", F.lit(0).alias("l_part"), F.lit(0).alias("r_part"))
        d = df.join(few(hot), "key", "left")
        mine = F.coalesce(F.pmod(F.xxhash64(rep), F.col(f"{own}_parts")), F.lit(0)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}_parts"), F.lit(1)) - 1))
        return d.select(rep, "key", mine.alias(f"{own}_part"), every.alias(f"{other}_part"))

    met = spread(lk, "left_rep", "l", "r").join(spread(rk, "right_rep", "r", "l"), ["key", "l_part", "r_part"])
    return met.select("left_rep", "right_rep").distinct()


def near(a: str, b: str) -> int:
    """Vote of two words: same but for a slip, or not; abstains where one is missing."""
    if not a or not b:
        return 0
    return 1 if canonical.edits(a, b, 2) <= (2 if min(len(a), len(b)) >= 7 else 1 if min(len(a), len(b)) >= 5 else 0) else -1


def votes(lw, lk, lp, lm, la, lpaths, li, rw, rk, rp, rm, ra, rpaths, ri) -> tuple[int, ...]:
    """Votes of VOTERS on one candidate."""
    lwords, rwords = {lw, lp} - {""}, {rw, rp} - {""}
    word = near(lw, rw) if lw and rw else 0
    product = (1 if lp == rp else -1) if lp and rp else 0
    maker = (1 if lm == rm else -1) if lm and rm else 0
    spots = 0
    if la and ra:
        spots = 1 if set(la) & set(ra) else 0
    icons = 1 if set(li) & set(ri) else 0
    kind = (1 if lk == rk else -1) if lk and rk else 0
    # any word of a side exactly among those of the other, in whatever field; a slip is no vote
    lall, rall = lwords | set(lpaths), rwords | set(rpaths)
    path = 0
    if lall and rall and (lall & rall):
        path = 1
    elif lall and rall and all(near(a, b) < 0 for a in lall for b in rall):
        path = -1
    return word, product, maker, spots, icons, kind, path


def vote_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_rep, right_rep, votes) of the candidates."""
    cols = ["word", "kind", "product", "maker", "addresses", "paths", "icons"]
    l = left.select(F.col("rep").alias("left_rep"), *[F.col(c).alias(f"l_{c}") for c in cols])  # noqa: E741
    r = right.select(F.col("rep").alias("right_rep"), *[F.col(c).alias(f"r_{c}") for c in cols])
    met = pairs.join(l, "left_rep").join(r, "right_rep")
    met = met.select("left_rep", "right_rep", *[f"{s}_{c}" for s in "lr" for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [votes(*v) for v in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["left_rep", "right_rep", "votes"])

    return met.mapInArrow(run, "left_rep bigint, right_rep bigint, votes array<int>")


class LabelModel:
    """Two-class generative model of vote patterns with joint tables for dependent functions.

    Blocks of at most ``most`` functions are learned: of all pairs, those whose votes share most information given the
    class come together first. ``known`` fixes the share of matches in which a function votes against.
    """

    def __init__(self, rounds: int = 100, smooth: float = 0.5, dependent: float = 0.02, most: int = 3, known: dict[str, float] | None = None):
        self.rounds, self.smooth, self.dependent, self.most = rounds, smooth, dependent, most
        self.known = {VOTERS.index(k): v for k, v in (KNOWN_ERRORS if known is None else known).items()}

    def fit(self, patterns: dict[tuple[int, ...], int]) -> LabelModel:
        """EM from the start that agreement speaks for and disagreement against a match."""
        self.blocks = [(i,) for i in range(len(VOTERS))]
        start = {v: 1 / (1 + math.exp(-(1.6 * sum(v) - 1.2))) for v in patterns}
        post = self._em(patterns, start)
        self.information = {p: self._information(patterns, post, p) for p in combinations(range(len(VOTERS)), 2)}
        for (i, j), strength in sorted(self.information.items(), key=lambda x: (-x[1], x[0])):
            a, b = (next(k for k in self.blocks if x in k) for x in (i, j))
            if strength > self.dependent and a != b and len(a) + len(b) <= self.most:
                self.blocks = [k for k in self.blocks if k not in (a, b)] + [tuple(sorted(a + b))]
        self.post = self._em(patterns, post)
        return self

    def _em(self, patterns, post) -> dict[tuple[int, ...], float]:
        for _ in range(self.rounds):
            total = [self.smooth, self.smooth]
            tables = [[{}, {}] for _ in self.blocks]
            for v, n in patterns.items():
                for c, w in ((1, post[v] * n), (0, (1 - post[v]) * n)):
                    total[c] += w
                    for t, b in zip(tables, self.blocks):
                        k = tuple(v[i] for i in b)
                        t[c][k] = t[c].get(k, 0.0) + w
            self.total = total
            self.tables = [(self._rates(b, t[0], total[0], {}), self._rates(b, t[1], total[1], self.known)) for b, t in zip(self.blocks, tables)]
            new = {v: self.posterior(v) for v in patterns}
            moved = max((abs(new[v] - post[v]) for v in patterns), default=0)
            post = new
            if moved < 1e-6:
                break
        return post

    def _rates(self, block, counts, total, known) -> dict[tuple[int, ...], float]:
        """Smoothed shares of a block's votes; where a function's share of votes against is known, the cells keep to it."""
        cells = [()]
        for _ in block:
            cells = [(*c, x) for c in cells for x in (-1, 0, 1)]
        rates = {c: (counts.get(c, 0.0) + self.smooth) / (total + len(cells) * self.smooth) for c in cells}
        for at, i in enumerate(block):
            if i in known:
                against = sum(r for c, r in rates.items() if c[at] == -1)
                scale = known[i] / against, (1 - known[i]) / (1 - against)
                rates = {c: r * scale[c[at] != -1] for c, r in rates.items()}
        return rates

    def posterior(self, v: tuple[int, ...]) -> float:
        odds = math.log(self.total[1] / self.total[0])
        for (no, yes), b in zip(self.tables, self.blocks):
            k = tuple(v[i] for i in b)
            odds += math.log(yes[k] / no[k])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))

    @staticmethod
    def _information(patterns, post, pair) -> float:
        """Mutual information of two functions' votes given the class."""
        i, j = pair
        out = 0.0
        n_all = sum(patterns.values()) or 1
        for c in (0, 1):
            joint, a, b, n = {}, {}, {}, 0.0
            for v, k in patterns.items():
                w = k * (post[v] if c else 1 - post[v])
                n += w
                joint[v[i], v[j]] = joint.get((v[i], v[j]), 0) + w
                a[v[i]], b[v[j]] = a.get(v[i], 0) + w, b.get(v[j], 0) + w
            if n > 0:
                out += sum(w / n_all * math.log(w * n / (a[x] * b[y])) for (x, y), w in joint.items() if w > 0)
        return out


def link(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(left_id, right_id, confidence, votes) of the matching rows of two evidence tables (id, EVIDENCE)."""
    left, right = without_generic(left, right)
    lreps, lmembers = classes(left)
    rreps, rmembers = classes(right)
    lreps, rreps = checkpoint(lreps), checkpoint(rreps)
    voted = checkpoint(vote_pairs(candidates(lreps, rreps), lreps, rreps))
    counts = voted.groupBy("votes").count().collect()  # at most 3 ** len(VOTERS) patterns
    patterns = {tuple(r.votes): r["count"] for r in counts}
    spark = left.sparkSession
    model = LabelModel().fit(patterns) if patterns else None
    scored = [(list(v), float(p)) for v in patterns if (p := model.posterior(v)) >= threshold]
    table = spark.createDataFrame(scored, "votes array<int>, confidence double")
    hit = voted.join(F.broadcast(table), "votes")
    out = hit.join(lmembers.select(F.col("id").alias("left_id"), F.col("rep").alias("left_rep")), "left_rep")
    out = out.join(rmembers.select(F.col("id").alias("right_id"), F.col("rep").alias("right_rep")), "right_rep")
    return out.select("left_id", "right_id", "confidence", "votes")
