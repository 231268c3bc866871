"""URL filters: rules by host and path, then logistic regression on hashed character n-grams.

Judging is DataFrame functions alone.  The regression is trained from a small labelled table (at most
MOST_LABELLED rows) in its kernel form: one row holds all labelled URLs, the driver takes Newton steps on
one coefficient per URL until the gradient vanishes, and the weights per bucket follow from them.  The margin that blocks is chosen
on labelled URLs which the fit that judges them has not seen.  Judging needs no
shuffle: each URL's buckets are looked up in an array of 2**bits weights.

Edge cases: a null URL or one without `://` has an empty host and path, and the method judges the
empty URL; urls of any length cost time in proportion; repeated rows are judged alike; other columns are ignored;
a rule with an empty path fits every path of its host.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import table

#: The rules of the query (verdict, host and path).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
MOST_LABELLED = 200
#: The labelled table (1: block).
LABELLED = [
    (0, "https://news.example.org/fr/120"), (0, "https://blog.example.net/en/25"), (0, "http://docs.example.com/fr/825?page=2"),
    (0, "https://www.example.org/en/685"), (0, "http://m.example.net/es/474.html"), (0, "https://library.example.com/de/9/"),
    (0, "https://wiki.example.org/fr/671?utm_source=feed"), (0, "http://science.example.net/fr/960#top"), (0, "https://museum.example.com/es/533/"),
    (0, "https://school.example.org/de/311"), (0, "https://city.example.net/en/42"), (0, "http://garden.example.com/fr/18"),
    (0, "https://recipes.example.org/en/77"), (0, "https://travel.example.net/fr/640"), (0, "https://forum.example.org/de/205.html"),
    (0, "https://example.com/"), (0, "https://example.org/en/1"), (0, "https://example.net/fr/2"),
    (1, "https://spam-ring.example.org/en/729"), (1, "http://mail-spam.example.net/fr/13"), (1, "https://farm-links.example.com/de/31"),
    (1, "https://spam-links.example.org/es/99"), (1, "http://quick-pills.example.net/en/buy-now"), (1, "https://casino-bonus.example.com/fr/win"),
    (1, "http://free-casino.example.org/en/spin?bonus=1"), (1, "https://link-farm.example.net/en/500"), (1, "http://pills-shop.example.com/de/order"),
    (1, "https://content-farm.example.org/fr/683.html"), (1, "https://buy-followers.example.net/fr/7"), (1, "http://adult-cams.example.org/en/live"),
    (1, "https://seo-spam.example.com/fr/backlinks"), (1, "http://casino-farm.example.net/fr/88#top"), (1, "https://spam.example.org/fr/4/"),
    (1, "https://warez-crack.example.com/fr/keygen"), (1, "http://loan-spam.example.net/fr/fast-cash"), (1, "https://farm-of-links.example.org/de/6"),
    # generic families, the two classes with the same paths
    (0, "http://weather.example.com/en/6"), (1, "http://poker-room.example.com/en/6"), (0, "https://www.history.example.org/en/54/"),
    (1, "https://www.slots-spin.example.org/en/54/"), (0, "http://m.music.example.net/de/176.html"), (1, "http://m.lucky-jackpot.example.net/de/176.html"),
    (0, "https://blog.library.example.com/de/372?page=2"), (1, "https://blog.sports-betting.example.com/de/372?page=2"), (0, "http://university.example.org/fr/642#top"),
    (1, "http://bet-now.example.org/fr/642#top"), (0, "https://www.hospital.example.net/fr/986?utm_source=feed"), (1, "https://www.roulette-live.example.net/fr/986?utm_source=feed"),
    (0, "http://m.railway.example.com/es/1404"), (1, "http://m.bingo-bonus.example.com/es/1404"), (0, "https://blog.gardening.example.org/es/1896/"),
    (1, "https://blog.casino-jackpot.example.org/es/1896/"), (0, "http://cooking.example.net/en/2462.html"), (1, "http://online-casino.example.net/en/2462.html"),
    (0, "https://www.football.example.com/en/3102?page=2"), (1, "https://www.betting-tips.example.com/en/3102?page=2"), (0, "http://m.chess-club.example.org/de/3816#top"),
    (1, "http://m.porn-tube.example.org/de/3816#top"), (0, "https://blog.theatre.example.net/de/4604?utm_source=feed"), (1, "https://blog.sex-chat.example.net/de/4604?utm_source=feed"),
    (0, "http://gallery.example.com/fr/5466"), (1, "http://xxx-videos.example.com/fr/5466"), (0, "https://www.parliament.example.org/fr/6402/"),
    (1, "https://www.adult-dating.example.org/fr/6402/"), (0, "http://m.county-records.example.net/es/7412.html"), (1, "http://m.hot-cams.example.net/es/7412.html"),
    (0, "https://blog.astronomy.example.com/es/8496?page=2"), (1, "https://blog.nude-pics.example.com/es/8496?page=2"), (0, "http://physics.example.org/en/9654#top"),
    (1, "http://escort-ads.example.org/en/9654#top"), (0, "https://www.biology.example.net/en/1086?utm_source=feed"), (1, "https://www.pharma-shop.example.net/en/1086?utm_source=feed"),
    (0, "http://m.maths-help.example.com/de/2392"), (1, "http://m.diet-pills.example.com/de/2392"), (0, "https://blog.open-source.example.org/de/3772/"),
    (1, "https://blog.viagra-store.example.org/de/3772/"), (0, "http://python-docs.example.net/fr/5226.html"), (1, "http://cheap-meds.example.net/fr/5226.html"),
    (0, "https://www.kernel-notes.example.com/fr/6754?page=2"), (1, "https://www.weight-loss-pills.example.com/fr/6754?page=2"), (0, "http://m.bird-watch.example.org/es/8356#top"),
    (1, "http://m.cheap-watches.example.org/es/8356#top"), (0, "https://blog.hiking.example.net/es/232?utm_source=feed"), (1, "https://blog.replica-bags.example.net/es/232?utm_source=feed"),
    (0, "http://sailing.example.com/en/1982"), (1, "http://cheap-loans.example.com/en/1982"), (0, "https://www.village-news.example.org/en/3806/"),
    (1, "https://www.payday-loan.example.org/en/3806/"), (0, "http://m.radio.example.net/de/5704.html"), (1, "http://m.fast-credit.example.net/de/5704.html"),
    (0, "https://blog.cinema.example.com/de/7676?page=2"), (1, "https://blog.crypto-giveaway.example.com/de/7676?page=2"), (0, "http://poetry.example.org/fr/9722#top"),
    (1, "http://free-money.example.org/fr/9722#top"), (0, "https://www.archive.example.net/fr/2042?utm_source=feed"), (1, "https://www.free-prizes.example.net/fr/2042?utm_source=feed"),
    (0, "http://m.geology.example.com/es/4236"), (1, "http://m.free-iphone.example.com/es/4236"), (0, "https://blog.letters.example.org/es/6504/"),
    (1, "https://blog.win-cash.example.org/es/6504/"), (0, "http://schoolbook.example.net/en/8846.html"), (1, "http://click-ads.example.net/en/8846.html"),
    (0, "https://www.townhall.example.com/en/1462?page=2"), (1, "https://www.pop-ads.example.com/en/1462?page=2"), (0, "http://m.bakery.example.org/de/3952#top"),
    (1, "http://m.ad-server.example.org/de/3952#top"), (0, "https://blog.orchard.example.net/de/6516?utm_source=feed"), (1, "https://blog.ad-tracker.example.net/de/6516?utm_source=feed"),
    (0, "http://bicycle.example.com/fr/9154"), (1, "http://tracking-pixel.example.com/fr/9154"), (0, "https://www.harbor.example.org/fr/2066/"),
    (1, "https://www.click-track.example.org/fr/2066/"), (0, "http://m.museum-of-art.example.net/es/4852.html"), (1, "http://m.banner-ads.example.net/es/4852.html"),
    (0, "https://blog.choir.example.com/es/7712?page=2"), (1, "https://blog.spam-mail.example.com/es/7712?page=2"), (0, "http://forestry.example.org/en/846#top"),
    (1, "http://bulk-spam.example.org/en/846#top"), (0, "https://www.painting.example.net/en/3854?utm_source=feed"), (1, "https://www.link-spam.example.net/en/3854?utm_source=feed"),
    (0, "http://m.pottery.example.com/de/6936"), (1, "http://m.traffic-bot.example.com/de/6936"), (0, "https://blog.sculpture.example.org/de/292/"),
    (1, "https://blog.buy-likes.example.org/de/292/"), (0, "http://swimming.example.net/fr/3522.html"), (1, "http://serial-keys.example.net/fr/3522.html"),
    (0, "https://www.economy.example.com/fr/6826?page=2"), (1, "https://www.cracked-games.example.com/fr/6826?page=2"), (0, "http://m.farmers-market.example.org/es/404#top"),
    (1, "http://m.torrent-warez.example.org/es/404#top"), (0, "https://blog.language-lab.example.net/es/3856?utm_source=feed"), (1, "https://blog.free-downloads.example.net/es/3856?utm_source=feed"),
    (0, "http://clinic.example.com/en/7382"), (1, "http://virus-alert.example.com/en/7382"), (0, "https://www.dentist.example.org/en/1182/"),
    (1, "https://www.phish-login.example.org/en/1182/"),
    (1, "http://adult-films.example.org/en/7106"), (1, "https://www.adults-only.example.net/fr/8804/"),
    # clean names that are no words: syllables in random order
    (0, "http://heonintion.example.com/en/3671"), (0, "https://www.leblere.example.org/en/9090/"), (0, "http://m.isonoude.example.net/en/2262.html"),
    (0, "https://blog.ingesis.example.com/de/7121?page=2"), (0, "http://atretioning.example.org/de/8983#top"), (0, "https://www.oureinor.example.net/de/3231?utm_source=feed"),
    (0, "http://m.isasit.example.com/fr/2157"), (0, "https://blog.enouitle.example.org/fr/2238/"), (0, "http://sterinst.example.net/fr/3905.html"),
    (0, "https://www.esndthou.example.com/es/4241?page=2"), (0, "http://m.inghaer.example.org/es/508#top"), (0, "https://blog.isdeed.example.net/es/1894?utm_source=feed"),
    (0, "http://anesve.example.com/en/7042"), (0, "https://www.reitea.example.org/en/8802/"), (0, "http://m.ofleing.example.net/en/6987.html"),
    (0, "https://blog.lytotion.example.com/de/651?page=2"), (0, "http://deonon.example.org/de/7887#top"), (0, "https://www.ernded.example.net/de/2652?utm_source=feed"),
    (0, "http://m.isinthhe.example.com/fr/4637"), (0, "https://blog.orreas.example.org/fr/5990/"), (0, "http://deenitat.example.net/fr/7652.html"),
    (0, "https://www.iseahe.example.com/es/5793?page=2"), (0, "http://m.blehaha.example.org/es/4870#top"), (0, "https://blog.anennt.example.net/es/8001?utm_source=feed"),
    (0, "http://inghely.example.com/en/9628"), (0, "https://www.ntingve.example.org/en/7438/"), (0, "http://m.tivetion.example.net/en/9151.html"),
    (0, "https://blog.ishaon.example.com/de/615?page=2"), (0, "http://inhereing.example.org/de/4747#top"), (0, "https://www.ittion.example.net/de/3167?utm_source=feed"),
    (0, "http://m.ising.example.com/fr/6372"), (0, "https://blog.attoouan.example.org/fr/8219/"), (0, "http://ndhait.example.net/fr/6018.html"),
    (0, "https://www.hearou.example.com/es/8343?page=2"), (0, "http://m.ndbleha.example.org/es/8066#top"), (0, "https://blog.ingtoble.example.net/es/6059?utm_source=feed"),
    (0, "http://haasen.example.com/en/2690"), (0, "https://www.edatto.example.org/en/1158/"), (0, "http://m.edtoed.example.net/en/8415.html"),
    (0, "https://blog.tohait.example.com/de/9135?page=2"), (0, "http://tionvehele.example.org/de/4492#top"), (0, "https://www.ntreve.example.net/de/3326?utm_source=feed"),
    (0, "http://m.oritle.example.com/fr/3084"), (0, "https://blog.ittioning.example.org/fr/7302/"), (0, "http://ofining.example.net/fr/7744.html"),
    (0, "https://www.ndtioner.example.com/es/5447?page=2"), (0, "http://m.oferea.example.org/es/209#top"), (0, "https://blog.ingntof.example.net/es/2411?utm_source=feed"),
    (0, "http://thofhe.example.com/en/1986"), (0, "https://www.starthde.example.org/en/7031/"), (0, "http://m.edtoor.example.net/en/908.html"),
    (0, "https://blog.dendas.example.com/de/4715?page=2"), (0, "http://intoha.example.org/de/1436#top"), (0, "https://www.lyntde.example.net/de/1445?utm_source=feed"),
    (0, "http://m.enednter.example.com/fr/7960"), (0, "https://blog.editleha.example.org/fr/7678/"), (0, "http://erthed.example.net/fr/3545.html"),
    (0, "https://www.outionou.example.com/es/8728?page=2"), (0, "http://m.learnt.example.org/es/8329#top"), (0, "https://blog.ernthand.example.net/es/3909?utm_source=feed"),
]


@dataclass(frozen=True)
class Settings:
    size: int = 3  # characters of the shortest n-gram
    longest: int = 3  # and of the longest
    bits: int = 10
    decay: float = 0.001
    care: float = 2.0  # how much more a clean page blocked counts than another missed, as most pages are clean
    tolerance: float = 1e-9  # largest entry of the mean gradient that ends the fit


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null without one.  rules: a short list."""
    out = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*out)


def buckets(host: Column, path: Column, s: Settings) -> Column:
    """Distinct hashed character n-grams of each label of the host, as ^label$, and of ^|path$; none crosses a dot of the host."""
    bounded = F.concat(F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("^"), x, F.lit("$"))), F.array(F.concat(F.lit("^|"), path, F.lit("$"))))
    codes = lambda text: F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    hashed = lambda c, i, n: F.aggregate(F.slice(c, i + 1, F.lit(n)), F.lit(7).cast("long"), lambda h, v: (h * 1000003 + v) % 2147483647) % (1 << s.bits)
    of_size = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: hashed(c, i, n))).otherwise(F.array().cast("array<bigint>"))
    grams = F.transform(F.transform(bounded, codes), lambda c: F.concat(*(of_size(c, n) for n in range(s.size, s.longest + 1))))
    return F.array_distinct(F.flatten(grams)).cast("array<int>")


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(y, u) for y, u in LABELLED], "label int, url string")


def coefficients(k: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Minimise the mean logistic loss of k a plus decay / 2 a k a, by damped Newton steps down to the tolerance."""
    gradient = lambda a: s.decay * a + (1 / (1 + np.exp(-(k @ a))) - y) / len(y)
    a = np.zeros(len(y))
    for _ in range(1000):
        g = gradient(a)
        if np.abs(g).max() <= s.tolerance:
            return a
        p = 1 / (1 + np.exp(-(k @ a)))
        step = np.linalg.solve(s.decay * np.eye(len(y)) + (p * (1 - p) / len(y))[:, None] * k, g)
        size = 1.0
        while size > 1e-6 and np.linalg.norm(gradient(a - size * step)) >= np.linalg.norm(g):
            size /= 2
        a = a - size * step
    raise ValueError("the fit did not reach its tolerance")


def cut_of(k: np.ndarray, y: np.ndarray, s: Settings, folds: int = 10) -> float:
    """The margin that parts the classes best among margins of rows that their fold's fit has not seen; a share of clean rows blocked counts `care` times a share of others missed."""
    if not 0 < y.sum() < len(y):
        return 0.0
    margin, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for f in range(folds):
        seen, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        margin[held] = k[np.ix_(held, seen)] @ coefficients(k[np.ix_(seen, seen)], y[seen], s)
    levels = np.unique(margin)
    cuts = np.concatenate([[levels[0] - 1], (levels[1:] + levels[:-1]) / 2, [levels[-1] + 1]])
    good = [(margin[y == 1] > c).mean() + s.care * (margin[y == 0] <= c).mean() for c in cuts]
    best = np.flatnonzero(np.array(good) == max(good))
    return float(cuts[best[len(best) // 2]])


def fit(df: DataFrame, s: Settings = Settings(), cut: bool = False) -> tuple[list[float], float]:
    """(a weight for each bucket, bias) from labelled urls (label 1: block, url); cut: less the margin of `cut_of`."""
    if df.count() > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    host, path = parts(F.col("url"))
    one = df.select(F.col("label").cast("double").alias("y"), buckets(host, path, s).alias("x")).groupBy().agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("rows"))
    # similarity of two urls: the share of common buckets, plus one for the bias
    alike = lambda p, q: F.size(F.array_intersect(p["x"], q["x"])) / F.sqrt(F.size(p["x"]).cast("double") * F.size(q["x"])) + 1.0
    kernel = one.select("rows", F.transform("rows", lambda p: F.transform("rows", lambda q: alike(p, q))).alias("k"))
    found = kernel.first()
    rows, k = (found.rows or [], np.array(found.k or [])) if found else ([], np.zeros(0))
    weights = [0.0] * (1 << s.bits)
    if not rows:
        return weights, 0.0
    y = np.array([r.y for r in rows])
    a = coefficients(k, y, s)
    for r, v in zip(rows, a, strict=True):
        for b in r.x:
            weights[b] += float(v) / len(r.x) ** 0.5
    return weights, float(a.sum()) - (cut_of(k, y, s) if cut else 0.0)


def judged(df: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str]] = RULES, s: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, margin for every row of df (page_id, url)."""
    host, path = parts(F.col("url"))
    weights = F.split(F.lit(",".join(repr(w) if w else "0" for w in map(float, model[0]))), ",").cast("array<double>")  # folded to one literal
    cut = df.select("page_id", host.alias("host"), path.alias("path"))
    x = buckets(F.col("host"), F.col("path"), s)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, b: t + F.get(weights, b)) / F.sqrt(F.size(x).cast("double"))
    margin = F.get(F.transform(F.array(x), total), F.lit(0)) + F.lit(model[1])
    hit = matched(F.col("host"), F.col("path"), rules)
    return cut.select("page_id", "host", "path", hit.alias("hit"), margin.alias("margin")).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"), "margin"
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Settings(longest=5, bits=18)
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), fit(labelled(spark), s, cut=True), s=s)
