"""URL filter: path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds the vocabulary's terms in the lower-cased url; a hit counts if no letter or digit
stands on either side of it. Each distinct term adds its weight: one strict term, or several soft ones, reach ``LEAST``
and the url is blocked. Repeats of one term add nothing.

A rule is ``host/path``: it fits its host and all subdomains if the url's path begins with the rule's; of those that
fit, the longest wins and its verdict replaces the vocabulary's.

Null urls, and urls without ``://``, have an empty host and path and fit no rule; the vocabulary still reads what there
is. Repeated rows get equal results; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small

STRICT, SOFT, LEAST = 2, 1, 2
#: Words that say by themselves what a page sells.
_STRICT = """
    porn porno pornos pornography pornhub xxx xxxx hentai camgirl camgirls camsex sexcam sexcams sexchat milf milfs gangbang blowjob creampie nudes upskirt
    escort escorts callgirl callgirls onlyfans sportsbook sportsbooks sportsbetting bookmaker bookmakers bookies freebet freebets freespins
    adserver adservers adclick adclicks adtracker popunder popunders popads clickfraud malvertising
    viagra cialis levitra warez keygen keygens malware phishing linkfarm linkfarms spambot spambots spamdexing
"""
#: Words that honest pages have too; two different ones of them tell.
_SOFT = """
    adult adults sex sexy nude erotic erotica fetish webcam webcams hookup hookups dating
    casino casinos poker betting bet bets gambling slots jackpot roulette blackjack baccarat lottery lotto
    ad ads advert adverts advertising banner banners promo affiliate affiliates popup popups clickbait adtech
    pills pharmacy steroids tramadol phentermine torrent torrents crack hack
    free freebie freebies bonus loan loans payday cheap cheapest discount discounts coupon coupons
    spam spammy spammer spammers backlink backlinks
"""
#: (first words, second words): strict as a pair, joined by ``-`` or ``_`` or nothing, where neither word tells alone.
_PAIRS = (
    ("adult", "x xx xxx video videos movie movies film films cam cams chat pics photos stories toys shop site sites content only fun friend friends"),
    ("adults", "only"),
    ("x", "rated"),
    ("casino casinos poker bet bets betting slots lottery jackpot", "online win wins winner winners"),
    ("online", "casino casinos gambling betting poker slots pharmacy"),
    ("ad ads click clicks", "track tracker trackers tracking server servers"),
    ("tracking", "pixel pixels"),
    ("spam link content click", "farm farms"),
    ("spam", "bot bots link links site sites blog blogs network"),
    ("payday", "loan loans"),
)
VOCABULARY: dict[str, int] = {
    **dict.fromkeys(_SOFT.split(), SOFT),
    **dict.fromkeys(_STRICT.split(), STRICT),
    **{a + joint + b: STRICT for first, second in _PAIRS for a in first.split() for b in second.split() for joint in ("-", "_", "")},
}
#: (host, path): verdict
RULES: dict[tuple[str, str], str] = {
    ("com", "/en/"): "block",
    ("example.com", "/en/7"): "allow",
    ("net", "/de/"): "allow",
    ("example.net", "/de/8"): "block",
    ("org", "/es/"): "block",
}


class Filter:
    def __init__(self, vocabulary: dict[str, int] = VOCABULARY, rules: dict[tuple[str, str], str] = RULES):
        self.vocabulary, self.rules = dict(vocabulary), dict(rules)
        self._ready()

    def __getstate__(self):
        return self.vocabulary, self.rules

    def __setstate__(self, state):
        self.vocabulary, self.rules = state
        self._ready()

    def _ready(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for term in self.vocabulary:
            self.automaton.add_word(term, term)
        if self.vocabulary:
            self.automaton.make_automaton()
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for (host, path), verdict in self.rules.items():
            self.by_host.setdefault(host, []).append((path, verdict))

    def hits(self, url: str | None) -> dict[str, int]:
        """How often each term of the vocabulary stands in the url, between boundaries."""
        out: dict[str, int] = {}
        if not url or not self.vocabulary:
            return out
        u = _lower(url)
        for end, term in self.automaton.iter(u):
            first = end - len(term) + 1
            if not (first and _word(u[first - 1])) and not (end + 1 < len(u) and _word(u[end + 1])):
                out[term] = out.get(term, 0) + 1
        return out

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict."""
        best, labels = None, host
        while labels:
            for prefix, verdict in self.by_host.get(labels, ()):
                if path.startswith(prefix) and (best is None or len(labels + prefix) > len(best[0])):
                    best = labels + prefix, verdict
            labels = labels.partition(".")[2]
        return best

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        """(host, path, rule, verdict, distinct strict terms, distinct soft terms)."""
        host, path = split(url)
        found = self.rule(host, path)
        hits = self.hits(url)
        weights = [self.vocabulary[t] for t in hits]
        strict = sum(w >= LEAST for w in weights)
        verdict = found[1] if found else "block" if sum(weights) >= LEAST else "allow"
        return host, path, found[0] if found else None, verdict, strict, len(hits) - strict


_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lower(s: str) -> str:
    return s.translate(_TO_LOWER)


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((k for k in (rest.find(c) for c in "?#") if k >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (_lower(rest), "") if slash < 0 else (_lower(rest[:slash]), rest[slash:])


def judged(pages: DataFrame, rules: Filter | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, n_strict, n_soft) for every row."""
    own = rules or Filter()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for batch in small(batches):
            got = list(zip(*map(own.judge, batch.column("url").to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, k) for v, k in zip(got, kinds, strict=True))], names=["id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long").withColumnRenamed("id", id_col)
