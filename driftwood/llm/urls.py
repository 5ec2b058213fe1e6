"""URL filter: host and path rules, and for what no rule fits, logistic regression on hashed character n-grams.

The model learns from a small labelled table. Features of host and path are kept apart; an n-gram that a URL holds counts
once. Parsing, rules, features and scores are column expressions; only the labelled rows' features come to the driver.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES = 4096, (3, 4, 5)
#: The bound on the labelled rows; more are an error.
MOST_LABELLED = 5000
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Invented URLs to learn from, labelled by hand. Hosts of either class end alike; names and paths tell them apart.
BLOCKED = """
casino-royal.org/slots/free-spins best-casino-bets.net/poker/bonus?ref=7 onlinecasino24.com/jackpot/win-now www.lucky-slots.org/casino/bonus-code.html bets365x.net/sports-betting/odds
poker-bets.com/download/free-chips freebets24.org/promo/deposit-bonus mega-jackpot.net/roulette/live spin-and-win.org/casino/welcome-bonus m.sportbets.net/betting-tips/today
cheap-pills-online.net/buy/viagra-cheap buy-cheap-meds.org/order/cialis-no-prescription www.pharma-pills.com/buy/generic-viagra.html discount-meds24.net/order/tramadol weightloss-pills.org/buy/miracle-diet
adult-video.net/xxx/watch/12 xxx-cams.org/live/hot-girls www.hot-adult-dating.com/join/free-sex sex-clips.net/porn/video-33.html adult-cams.org/xxx/free
trackads.net/click?id=9 click-ads.org/redirect/offer/33 ad-tracker.com/pixel/click.gif popup-ads.net/banner/offer.html adserver24.org/click/track
free-iphone-winner.net/claim/prize win-prize-now.org/survey/claim-reward cheap-loans.net/payday/apply-now fast-loans24.org/instant-cash/apply free-money-online.com/get-rich/earn-cash-fast
torrent-warez.net/crack/keygen-download serial-keys.org/download/crack-full.html free-downloads-crack.com/keygen/full-version movies-torrent.net/watch-free/stream cheap-replica-watches.org/buy/rolex-replica
seo-backlinks.net/buy-links/cheap spam-mill.org/link-farm/page-4 article-spinner.com/buy/cheap-backlinks followers-cheap.net/buy/likes-now replica-bags.org/cheap/discount-sale
""".split()
ALLOWED = """
www.city-library.org/catalogue/new-books national-museum.net/exhibitions/roman-coins.html daily-gazette.com/news/council-votes-on-budget weather-office.org/forecast/week blog.home-gardening.net/posts/pruning-roses
recipes-kitchen.com/soup/onion-soup.html university.org/departments/physics/staff general-hospital.net/patients/visiting-hours cityhall.org/services/waste-collection theatre-royal.com/programme/season
history-journal.net/articles/medieval-trade science-review.org/issue/12/article/4 astronomy-club.com/observing/moon-map mathematics.net/lectures/linear-algebra.pdf mountain-hiking.org/trails/north-ridge
harbour-authority.net/tides/table railway-timetable.com/stations/central www.local-bakery.org/about docs.python-guide.net/tutorial/functions.html forum.woodworking.org/topic/dovetail-joints
music-school.com/courses/violin m.football-results.net/league/table parish-church.org/history travel-notes.net/italy/three-days-in-rome blog.open-maps.org/2019/new-tiles
chess-club.com/games/annotated bird-watching.net/species/heron wiki.history-society.org/page/old-bridge encyclopedia.net/wiki/photosynthesis statistics-office.org/tables/population
primary-school.com/parents/calendar law-review.net/cases/2011/appeal energy-agency.org/reports/solar-power www.farmers-market.com/stalls code-archive.net/projects/parser/readme
film-festival.org/2018/jury poetry-foundation.net/poems/winter health-service.org/conditions/asthma consumer-advice.com/guides/mortgages public-radio.net/programmes/morning-news
""".split()


def _example_rows() -> list[tuple[str, int]]:
    return [(f"http{'s' * (k % 2)}://{u}", y) for y, urls in ((1, BLOCKED), (0, ALLOWED)) for k, u in enumerate(urls)]


def example_labels(spark: SparkSession) -> DataFrame:
    """(url, blocked): the small labelled table."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y in _example_rows()) + " AS t(url, blocked)")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://, and for null."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features() -> Column:
    """The buckets of the n-grams of the columns host and path, each once; any number counts as 0."""
    text = {c: f"concat('{mark}', regexp_replace({c}, '[0-9]+', '0'), '{mark}')" for c, mark in (("host", "."), ("path", "/"))}
    grams = [
        f"transform(sequence(1, greatest(length({text[c]}) - {n - 1}, 1)), i -> substring({text[c]}, i, {n}))"
        for c in text
        for n in SIZES
    ]
    tagged = [f"transform({g}, g -> pmod(xxhash64({k}, g), {BUCKETS}))" for k, g in enumerate(grams)]
    return F.expr(f"array_distinct(concat({', '.join(tagged)}))")


def train(labelled: DataFrame, *, epochs: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias by full-batch gradient descent; rows with a null label count for nothing."""
    rows = labelled.where("blocked IN (0, 1)").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).select(features().alias("x"), "blocked").limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    weights, bias = [0.0] * BUCKETS, 0.0
    each = sorted((sorted(r["x"]), r["blocked"]) for r in rows)
    used = sorted({b for x, _ in each for b in x})
    for _ in range(epochs if each else 0):
        step, shift = dict.fromkeys(used, 0.0), 0.0
        for x, y in each:
            wrong = 1 / (1 + exp(-max(-30.0, min(30.0, bias + sum(weights[b] for b in x))))) - y
            shift += wrong
            for b in x:
                step[b] += wrong
        for b in used:
            weights[b] -= rate * (step[b] / len(each) + decay * weights[b])
        bias -= rate * shift / len(each)
    return weights, bias


def judge(pages: DataFrame, *, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of pages (page_id, url).

    A rule fits its host and all subdomains, where the path starts with the rule's; of several the longest wins, then the
    first in the alphabet. Where none fits, rule is null and the model blocks at a score of 0.5. A null url, or one
    without ://, has an empty host and path. Repeated rows are each judged; other columns are ignored.
    """
    weights, bias = train(example_labels(pages.sparkSession) if labelled is None else labelled)
    table = f"cast(split('{','.join(f'{w:.6g}' for w in weights)}', ',') AS array<double>)"
    out = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("x", features())
    logit = F.expr(f"aggregate(x, cast({bias!r} AS double), (a, b) -> a + element_at({table}, cast(b AS int) + 1))")
    rule, verdict = F.lit(None).cast("string"), F.when(logit >= 0, F.lit("block")).otherwise(F.lit("allow"))
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):  # the last to be wrapped is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), (1 / (1 + F.exp(-logit))).alias("score"))
