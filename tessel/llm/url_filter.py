"""URL filters: host and path rules, then a character language-model ratio.

Rules come first: the longest rule whose host is the URL's or a parent of it, and whose path the URL's begins with,
decides.  Other URLs are judged by two variable-order Markov models over the bytes of what is read of an address, one of
accepted and one of rejected addresses, each an interpolation of all orders up to ``ORDER`` (Witten-Bell) that adds up to 1
over all 256 bytes.  The score is the difference of the two log-likelihoods for each byte; the limit is calibrated so
that at most ``FALSE`` of all accepted readings of the table, and as few as possible of the rejected strings, fall on the
wrong side.

The models read what an address says of its site: the host without its last two labels and common prefixes, and the
words of the path, digits as one sign, without what the rules decide on.  Accepted are all distinct readings of the table
that no rule blocks and that hold none of the seed words: their n-grams are counted over the whole table, and all of them
count.  Rejected are the seed words (a parameter), singly and in pairs.  What a URL is given is the ratio's verdict alone:
names that are like the seed words fall, ones that hold one among much else don't.

A model of up to ``CONTEXTS`` contexts is sent to the tasks.  A larger one stays in tables: blocks of readings ask for each
distinct place (a byte and what stands before it) once, the recursion is evaluated for all places asked for, order by order,
by joins, and the blocks add up what they are told.  Both ways do the same sums in the same order.

Nulls: a null URL and one without ``://`` have an empty host and path, no rule, and are allowed.  Very long URLs are read
whole, each by one task.  Ties between rules go to the one that comes first; a score at the limit is allowed.  Repeated rows are judged
each; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.blocks import documents
from tessel.llm.common import forget, partitions, stored

ORDER = 5
#: Contexts that a process holds of the model of accepted addresses; a larger model stays in tables.
CONTEXTS = 200_000
#: Distinct places of a block of readings, and n-grams that are counted before they are handed on.
PLACES, COUNTED = 1 << 16, 1 << 18
FALSE = 0.002
REMEMBERED = 100_000

#: Words of addresses that are mostly not wanted.
SEEDS = ("casino", "poker", "slots", "roulette", "jackpot", "betting", "bets", "bet", "gamble", "lottery", "win", "winner", "prize", "bonus", "free", "cheap", "deal", "discount", "pills", "pharma", "viagra", "cialis", "meds", "drugs", "loan", "loans", "payday", "credit", "adult", "xxx", "sex", "porn", "cam", "dating", "escort", "nude", "spam", "farm", "ads", "adserver", "track", "tracker", "click", "banner", "popup", "affiliate", "warez", "crack", "keygen", "torrent", "replica", "fake", "phish", "malware", "hack")
#: Words of the above that also occur in addresses of other kinds; alone they don't make a URL a rejected one.
COMMON = frozenset(("win", "free", "deal", "credit", "farm", "track", "click", "hack", "crack", "fake", "bet", "cam", "discount", "winner", "cheap", "ads"))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, capitals, small), F.lit("")), F.coalesce(path, F.lit(""))


def split_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path; native."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    return rows.select("page_id", host.alias("host"), path.alias("path"))


def ruled(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds rule and ruling (null where no rule fits); the longest rule wins, then the one that comes first."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, ruling = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(ruling)
    return urls.withColumn("rule", rule).withColumn("ruling", ruling)


_DIGITS = re.compile(r"\d+")
_LANGUAGE = re.compile(r"/[a-z]{2}(?=/|$)")
_PREFIX = re.compile(r"^(?:www\d*|m|blog|mobile|web)\.")
_WORDS = re.compile(r"[^\W\d_]+")


def reading(host: str, path: str) -> str:
    """What the models read of a URL."""
    name = _PREFIX.sub("", host)
    labels = name.split(".")
    name = ".".join(labels[:-2]) if len(labels) > 2 else labels[0]
    return f"^{name}{_DIGITS.sub('0', _LANGUAGE.sub('', path.lower()))}$"


def signs(text: str) -> str:
    """The UTF-8 bytes of a text, as characters."""
    return text.encode("utf-8", "surrogatepass").decode("latin-1")


def follow(texts: Iterable[str], order: int = ORDER) -> Iterator[tuple[str, str]]:
    """Each context and what follows it, of strings as of :func:`signs`."""
    for s in texts:
        for k in range(1, len(s)):
            for n in range(min(order, k) + 1):
                yield s[k - n : k], s[k]


def places(s: str, order: int = ORDER) -> Iterator[tuple[str, str]]:
    """Each sign but the first, behind the longest context of it."""
    for k in range(1, len(s)):
        yield s[max(0, k - order) : k], s[k]


def held(counted: DataFrame) -> dict[tuple[str, str], int]:
    return {(r["context"], r["sign"]): r["n"] for r in counted.toLocalIterator()}


class Markov:
    """A variable-order model of bytes: Witten-Bell interpolation from order 0 up to the longest context seen."""

    ALPHABET = 256

    def __init__(self, counts: Mapping[tuple[str, str], int], order: int = ORDER):
        self.order = order
        after: dict[str, dict[str, int]] = defaultdict(dict)
        for (context, sign), n in counts.items():
            after[context][sign] = n
        self.table = {context: (found, sum(found.values()), len(found)) for context, found in after.items()}

    def probability(self, context: str, sign: str) -> float:
        p = 1 / self.ALPHABET
        for n in range(len(context) + 1):
            found = self.table.get(context[len(context) - n :])
            if found is None:
                break
            counts, total, kinds = found
            p = (counts.get(sign, 0) + kinds * p) / (total + kinds)
        return p

    def log_likelihood(self, text: str) -> float:
        return sum(math.log(self.probability(context, sign)) for context, sign in places(signs(text), self.order))


class Stored(Markov):
    """A model whose counts (context, sign, n) stay in a table, as their contexts are too many to hold.

    :func:`ratios` scores tables by it.  A single text, on the driver, fetches the contexts that it asks for.
    """

    def __init__(self, counted: DataFrame, contexts: int, order: int = ORDER):
        super().__init__({}, order)
        self.counted, self.contexts = counted, contexts

    def log_likelihood(self, text: str) -> float:
        asked = {context for context, _ in follow([signs(text)], self.order)}
        missing = asked - self.table.keys()
        if missing:
            rows = self.counted
            if self.table or self.contexts > CONTEXTS:
                if len(self.table) + len(missing) > CONTEXTS:
                    self.table, missing = {}, asked
                rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in missing], "context string")), "context")
            self.table |= dict.fromkeys(missing) | Markov(held(rows), self.order).table
        return super().log_likelihood(text)

    def probabilities(self, asked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """context, sign and p of distinct places, and the tables to forget behind it; as :meth:`probability`."""
        ends = asked.select(F.expr("explode(transform(sequence(0, length(context)), k -> substring(context, k + 1)))").alias("context"), "sign").distinct()
        all_after = self.counted.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        known = stored(ends.join(self.counted, ["context", "sign"], "left").join(all_after, "context", "left"), "url-known")
        levels: list[DataFrame] = []
        for n in range(self.order + 1):
            level = known.where(F.length("context") == n)
            if levels:
                shorter = levels[-1].select(F.col("context").alias("rest"), "sign", F.col("p").alias("lower"))
                level = level.withColumn("rest", F.expr("substring(context, 2)")).join(shorter, ["rest", "sign"])
            else:
                level = level.withColumn("lower", F.lit(1 / self.ALPHABET))
            p = (F.coalesce("n", F.lit(0)) + F.col("kinds") * F.col("lower")) / (F.col("total") + F.col("kinds"))
            levels.append(stored(level.select("context", "sign", F.when(F.col("total").isNull(), F.col("lower")).otherwise(p).alias("p")), "url-level"))
        found = levels[0]
        for level in levels[1:]:
            found = found.unionByName(level)
        return found, [known, *levels]


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    limit: float = 0.0
    memory: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        """Log-likelihood ratio a character; above the limit is rejected."""
        known = self.memory.get(text)
        if known is None:
            known = (self.rejected.log_likelihood(text) - self.accepted.log_likelihood(text)) / max(1, len(signs(text)) - 1)
            if len(self.memory) < REMEMBERED:
                self.memory[text] = known
        return known

    def __getstate__(self):
        return {"accepted": self.accepted, "rejected": self.rejected, "limit": self.limit, "memory": {}}


def seeded(text: str, seeds: tuple[str, ...]) -> bool:
    """Whether one of the words is a seed that isn't common, or two of them are seeds."""
    found = [w for w in _WORDS.findall(text) if w in seeds]
    return len(found) > 1 or any(w not in COMMON for w in found)


def with_reading(urls: DataFrame) -> DataFrame:
    """Adds text, what the models read; null without a host."""

    @F.pandas_udf("string")
    def read(hosts, paths):
        import pandas as pd

        return pd.Series([reading(h, p) if h else None for h, p in zip(hosts, paths, strict=True)], dtype="object")

    return urls.withColumn("text", read("host", "path"))


def ratios(texts: DataFrame, model: Ratio) -> DataFrame:
    """text and ratio of distinct readings; of a :class:`Stored` model a stored table."""
    if not isinstance(model.accepted, Stored):

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(0).to_pylist()], pa.float64())], names=["text", "ratio"])

        return texts.mapInArrow(scored, "text string, ratio double")

    spark, rejected, order = texts.sparkSession, model.rejected, model.accepted.order

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks: their texts, and the distinct places of these."""
        block, held_texts, asked = TaskContext.get().partitionId() << 32, [], set()

        def rows() -> pa.RecordBatch:
            none, nothing = [None] * len(held_texts), [None] * len(asked)
            columns = [[block] * (len(held_texts) + len(asked)), held_texts + nothing, none + [c for c, _ in asked], none + [x for _, x in asked]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["block", "text", "context", "sign"])

        for (text,) in documents(batches):
            held_texts.append(text)
            asked.update(places(signs(text), order))
            if len(asked) >= PLACES:
                yield rows()
                block, held_texts, asked = block + 1, [], set()
        if held_texts:
            yield rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of blocks: what is told of their places comes first, then their texts."""
        at, told = None, {}
        for batch in batches:
            found, scores = [], []
            for block, text, context, sign, p in documents([batch], 4096):
                if block != at:
                    at, told = block, {}
                if text is None:
                    told[context, sign] = math.log(p)
                else:
                    s = signs(text)
                    found.append(text)
                    scores.append((rejected.log_likelihood(text) - sum(told[place] for place in places(s, order))) / max(1, len(s) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["text", "ratio"])

    dealt = stored(texts.mapInArrow(deal, "block long, text string, context string, sign string"), "url-blocks")
    asked = dealt.where("text is null").drop("text")
    known, used = model.accepted.probabilities(asked.select("context", "sign").distinct())
    told = asked.join(known, ["context", "sign"]).unionByName(dealt.where("text is not null").drop("context", "sign"), allowMissingColumns=True)
    told = told.select("block", "text", "context", "sign", "p").repartition(partitions(spark), "block").sortWithinPartitions("block", F.asc_nulls_first("text"))
    out = stored(told.mapInArrow(add, "text string, ratio double"), "url-ratios")
    forget(spark, dealt, *used)
    return out


def fit(urls: DataFrame, seeds: tuple[str, ...] = SEEDS, contexts: int = CONTEXTS) -> Ratio:
    """Models from all distinct readings without seeds, and from the seeds; the limit is of all those readings too.

    A model of more than ``contexts`` contexts stays in a table, which the caller may :func:`forget` behind the last use.
    """

    @F.pandas_udf("boolean")
    def plain(texts):
        return texts.map(lambda t: not seeded(t, seeds)).astype(bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = follow(signs(t) for (t,) in documents(batches))
        while found := Counter(islice(pairs, COUNTED)):
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["context", "sign", "n"])

    accepted = with_reading(urls.where((F.col("host") != "") & (F.coalesce(F.col("ruling"), F.lit("")) != "block"))).select("text").distinct()
    rows = stored(accepted.where(plain("text")), "url-readings")
    counted = stored(rows.mapInArrow(count, "context string, sign string, n long").groupBy("context", "sign").agg(F.sum("n").alias("n")), "url-counts")
    size = counted.agg(F.countDistinct("context")).first()[0]
    good = Stored(counted, size) if size > contexts else Markov(held(counted) or Counter(follow(["^a/0$"])))
    built = [f"^{a}/0$" for a in seeds] + [f"^{a}-{b}/0$" for a in seeds for b in seeds if a != b]
    model = Ratio(good, Markov(Counter(follow(map(signs, built)))))
    found = ratios(rows, model)
    scores = found if isinstance(good, Stored) else stored(found.select("ratio"), "url-scores")
    # No lower than what all but a few of the accepted lie below, and no lower than an even ratio.
    least = scores.orderBy(F.desc("ratio")).limit(1 + int(FALSE * scores.count())).agg(F.min("ratio")).first()[0]
    model.limit = max(0.0, least or 0.0)
    forget(urls.sparkSession, rows, scores, *([] if isinstance(good, Stored) else [counted]))
    return model


JUDGED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("ratio", T.DoubleType())])


def judge(urls: DataFrame, model: Ratio) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio (null without a host) of URLs that :func:`ruled` has seen."""
    if isinstance(model.accepted, Stored):
        read = with_reading(urls)
        found = read.join(ratios(read.where("text is not null").select("text").distinct(), model), "text", "left")
        verdict = F.coalesce("ruling", F.when(F.col("ratio") > model.limit, "block").otherwise("allow"))
        return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, paths, rules, rulings = batch.columns
            ratios = [model.score(reading(h, p)) if h else None for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            verdicts = [v or ("block" if r is not None and r > model.limit else "allow") for v, r in zip(rulings.to_pylist(), ratios, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, rules, pa.array(verdicts, pa.string()), pa.array(ratios, pa.float64())], names=JUDGED.names)

    return urls.select("page_id", "host", "path", "rule", "ruling").mapInArrow(run, JUDGED)


def filter_urls(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, seeds: tuple[str, ...] = SEEDS, contexts: int = CONTEXTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    urls = ruled(split_urls(pages, id_col=id_col, url_col=url_col), rules)
    model = fit(urls, seeds, contexts)
    judged = judge(urls, model)
    if isinstance(model.accepted, Stored):
        forget(urls.sparkSession, model.accepted.counted)
    return judged
