"""URL filter: rules on host and path first, else logistic regression on hashed character n-grams.

The model knows nothing of the rules. Without a labelled table of one's own it is fitted on a small one that is written
down here: hosts of our own invention, of kinds that a crawl leaves out and of kinds that it keeps.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import table

#: Rule and verdict: a host suffix at a label's start, and a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Hosts whose pages are to be left out: gambling, pills, adult, advertising, link farms, malware, fraud.
BLOCKED = """
casino-royal.test lucky-casino.test www.casino24.test m.online-casino.test blog.casinobonus.test win-big.test bigwin-slots.test jackpot-win.test
m.slots-win.test poker-bets.test sports-bets.test www.bets365.test free-spins.test freebet.test blog.best-bets.test betting-tips.test roulette-free.test
cheap-meds.test pills-online.test www.buy-pills.test diet-pills.test m.pillstore.test cheap-viagra.test pharma-cheap.test no-prescription.test
cheap-watches.test replica-cheap.test adult-cams.test www.adultvideo.test m.adult-dating.test xxx-adult.test blog.hot-xxx.test sexy-singles.test
ads-server.test www.ads-click.test m.adsnet.test popup-ads.test ad-track.test track-click.test pixel-track.test trackads.test blog.clicktracker.test
spam-links.test linkfarm.test www.link-farm.test seo-spam.test m.spamblog.test backlink-farm.test content-farm.test spamdexing.test
free-download-crack.test warez-free.test www.keygen-crack.test torrent-free.test malware-drop.test fake-login.test phish-bank.test free-money.test
fast-loan.test payday-loans.test get-rich-win.test win-prize.test m.prize-win.test free-gift-cards.test crypto-win.test
""".split()
#: Hosts whose pages are to be kept.
KEPT = """
weather-report.test www.weather.test city-library.test m.library.test blog.museum.test national-museum.test history-notes.test www.history.test
garden-club.test m.gardening.test home-recipes.test www.recipes.test blog.cooking.test school-news.test high-school.test university.test m.faculty.test
science-daily.test www.physics.test chemistry.test blog.biology.test mathematics.test theorem.test river-watch.test mountain-huts.test www.trains.test
bus-timetable.test m.airport.test harbour.test town-council.test www.parliament.test ministry.test court-reports.test law-review.test
open-source.test www.software-docs.test blog.developer.test m.tutorials.test compiler.test database-notes.test operating-systems.test
music-theory.test orchestra.test www.theatre.test m.cinema.test painting.test blog.photography.test poetry.test literature.test translation.test
dictionary.test encyclopedia.test www.languages.test health-service.test hospital.test m.nursing.test blog.medicine.test fitness-trail.test
football-club.test www.athletics.test chess-club.test cycling.test farmers-market.test village-hall.test weekly-letter.test morning-post.test
the-thinker.test with-others.test nation-and-region.test other-hand.test thread-and-needle.test northern.test southern.test eastern-shore.test
""".split()
#: Paths that both kinds have.
PLACES = ("/", "/en/120", "/fr/77/", "/de/9031.html", "/es/415", "/en/2288/", "/index.html", "/2024/05/post")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host_col: str, path_col: str, rules) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((F.col(host_col) == domain) | F.col(host_col).endswith("." + domain)) & F.col(path_col).startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def ngrams(text: str, bits: int, sizes: tuple[int, ...] = (3, 4, 5)) -> np.ndarray:
    """Distinct hashed character n-grams of a URL's host and path."""
    raw = f"^{text}$".encode()
    return np.unique(np.array([zlib.crc32(raw[i : i + n]) & ((1 << bits) - 1) for n in sizes for i in range(len(raw) - n + 1)], np.int64))


def fit(urls: list[str], block: list[int], bits: int = 16, passes: int = 30, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression (the last is the bias), by AdaGrad over the rows in their order."""
    w, seen = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-8)
    rows = [np.append(ngrams(u, bits), 1 << bits) for u in urls]
    for _ in range(passes):
        for at, y in zip(rows, block, strict=True):
            g = (1 / (1 + np.exp(-np.clip(w[at].sum(), -30, 30))) - y) + penalty * w[at]
            seen[at] += g * g
            w[at] -= 0.5 * g / np.sqrt(seen[at]) / np.sqrt(len(at))
    return w


def predict(pages: DataFrame, column: str, weights: np.ndarray) -> DataFrame:
    """``pages`` with p_block, the model's probability for the host and path in ``column``."""
    names = pages.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    bits = (len(weights) - 1).bit_length() - 1
    known = np.flatnonzero(weights)
    small = dict(zip(known.tolist(), weights[known].tolist(), strict=True))  # a sparse copy travels to the tasks

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            z = np.array([math.fsum(small.get(x, 0.0) for x in ngrams(u, bits).tolist()) + small.get(1 << bits, 0.0) for u in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*names, "p_block"])

    return pages.mapInArrow(run, f"{schema}, p_block double")


def labelled_urls(spark) -> DataFrame:
    """(url, block): the table written down here, each host with some of the paths."""
    rows = [(f"http://{h}{PLACES[(i + k) % len(PLACES)]}", int(hosts is BLOCKED)) for hosts in (BLOCKED, KEPT) for i, h in enumerate(hosts) for k in range(4)]
    return spark.createDataFrame(rows, "url string, block int")


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, max_rows: int = 4000) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for each row of ``pages`` (page_id, url).

    ``labelled`` has (url, block 0/1); ``labelled_urls`` where it is None. At most ``max_rows``
    distinct labelled host-and-path texts, by hash order, are fitted on the driver. A rule's verdict wins; else block
    from p_block 0.5 on. A null url, or one without ``://``, has an empty host and path and is judged like any other.
    Without labels of both kinds the method allows all. Repeated rows are judged each; other columns are ignored.
    An empty table gives an empty result.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = parts.withColumn("rule", rule_of("host", "path", rules)).withColumn("place", F.concat("host", "path"))
    says = F.lit(None).cast("string")
    for rule, verdict in rules:
        says = F.when(F.col("rule") == rule, verdict).otherwise(says)
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    known = labelled.select(F.concat(host(F.col("url")), path(F.col("url"))).alias("place"), (F.col("block") > 0).cast("int").alias("block"))
    rows = known.groupBy("place").agg(F.max("block").alias("block")).orderBy(F.xxhash64("place"), "place").limit(max_rows).collect()
    block = [int(r["block"] or 0) for r in rows]
    weights = fit([r["place"] for r in rows], block) if 0 < sum(block) < len(block) else np.zeros(3)
    if not weights.any():
        weights = np.array([0.0, 0.0, -1.0])
    out = predict(ruled, "place", weights)
    return out.select("page_id", "host", "path", "rule", F.coalesce(says, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.round("p_block", 6).alias("p_block"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts for all ``pages``."""
    return judge_urls(table(spark, sf_dir, "pages"))
