"""Problems 2 and 5 over tables: fetched pages and crawl errors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import pages as P
from lectern.llm import residue as R
from lectern.sources.tables import bounded_sample, in_batches, one_per_key_in_place


def _host(url: str | None) -> str:
    return re.sub(r"^www\.", "", (re.match(r"(?i)https?://([^/?#:]*)", url or "") or [None, ""])[1].lower())


def _sample(fetched: DataFrame) -> list[tuple[str, str, str, list[P.Block]]]:
    """(host, raw, title, blocks) of the sample's HTML answers."""
    out = []
    for r in bounded_sample(fetched.select("fetch_id", "url", "bytes", "content_type"), "fetch_id", R.SAMPLE_PAGES):
        raw = P.read(r["bytes"])
        if P.is_html(r["content_type"], raw):
            out.append((_host(r["url"]), raw, *P.parse(raw)))
    return out


def _place(host: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\n{text}") >> 1


def site_counts(fetched: DataFrame, pages: list[tuple[str, list[P.Block]]]) -> list[dict[str, int]]:
    """For each of the pages (host, blocks), on how many of all pages of its host each of its texts stands.

    All pages of these hosts are read; what is counted are the texts of the pages given, a bounded number of sums, added
    up where the pages are read.  A page counts once, however often its row is repeated.
    """
    wanted = {_place(host, t) for host, blocks in pages for b in blocks if (t := P.recurring(b)) is not None}
    hosts = {host for host, _ in pages}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[int] = Counter()
        for batch in batches:
            for url, data, content_type in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = _host(url)
                if host not in hosts:
                    continue
                raw = P.read(data)
                if P.is_html(content_type, raw):
                    texts = {t for b in P.parse(raw)[1] if (t := P.recurring(b)) is not None}
                    sums.update(wanted.intersection(_place(host, t) for t in texts))
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int64()), pa.array([*sums.values()], pa.int64())], names=["place", "n"])

    one = one_per_key_in_place(fetched.select("fetch_id", "url", "bytes", "content_type"), "fetch_id")
    total = in_batches(one.select("url", "bytes", "content_type"), run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    counts = {r[0]: r[1] for r in total.collect()} if wanted else {}
    return [{t: counts.get(_place(host, t), 0) for b in blocks if (t := P.recurring(b)) is not None} for host, blocks in pages]


def _trained(fetched: DataFrame, sample: list[tuple[str, str, str, list[P.Block]]]) -> tuple[P.Chain, R.Judge]:
    first = sample[: P.TRAIN_PAGES]
    chain = P.train([(t, b) for _, _, t, b in first], site_counts(fetched, [(host, b) for host, _, _, b in first]))
    return chain, R.train_pages([(t, b, raw) for _, raw, t, b in sample], P.Reader(chain))


def models(fetched: DataFrame) -> tuple[P.Chain, R.Judge]:
    """The chain and the classifier, trained on the driver on a bounded sample; how often texts recur on a site is counted over all its pages."""
    return _trained(fetched, _sample(fetched))


def judged_pages(fetched: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per HTML answer (repeated rows included): fetch_id, kind of residue or null, furniture (numbers of blocks outside the main body); on demand title and text of the main body."""
    chain, judge = models(fetched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = P.Reader(chain)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, data, content_type in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = P.read(data)
                if not P.is_html(content_type, raw):
                    continue
                title, blocks = P.parse(raw)
                labels = reader.labels(title, blocks)
                rows[0].append(key)
                rows[1].append(R.page_kind(judge, title, blocks, labels, raw))
                rows[2].append(P.furniture(blocks, labels))
                if with_text:
                    rows[3].append(title)
                    rows[4].append("\n\n".join(P.main_text(blocks, labels)))
            arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.list_(pa.int64()))]
            names = ["fetch_id", "kind", "furniture"]
            if with_text:
                arrays += [pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())]
                names += ["title", "text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "fetch_id bigint, kind string, furniture array<bigint>" + (", title string, text string" if with_text else "")
    return in_batches(fetched.select("fetch_id", "bytes", "content_type"), run, schema)


def judged_entries(crawls: DataFrame) -> DataFrame:
    """(crawl_id, kind) of crawls with an entry that is residue, one row per kind."""
    sample = bounded_sample(crawls.select("crawl_id", "errors").where(F.size("errors") > 0), "crawl_id", R.SAMPLE_CRAWLS)
    judge = R.train_crawls([e for r in sample for e in r["errors"] if e])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds = [], []
            for key, errors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for kind in {R.entry_kind(judge, e) for e in errors or []} - {None}:
                    keys.append(key)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string())], names=["crawl_id", "kind"])

    return in_batches(crawls.select("crawl_id", "errors").where(F.size("errors") > 0), run, "crawl_id bigint, kind string").distinct()


def held_out(host: str) -> bool:
    """Whether a host is of the fifth that ``holdout`` trains nothing on."""
    return sum(host.encode("utf-8", "surrogatepass")) % 5 == 0


def holdout(fetched: DataFrame) -> DataFrame:
    """(label, predicted, sentences) over all pages of a fifth of the hosts, of which neither chain nor classifier has seen any."""
    sample = [x for x in _sample(fetched) if not held_out(x[0])]
    chain, judge = _trained(fetched, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = P.Reader(chain)
        for batch in batches:
            rows: list[tuple[int, str, str, int]] = []
            for key, url, data, content_type in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held_out(_host(url)):
                    continue
                raw = P.read(data)
                if not P.is_html(content_type, raw):
                    continue
                title, blocks = P.parse(raw)
                counts: dict[tuple[str, str], int] = {}
                for part in R.page_sentences([(title, blocks, reader.labels(title, blocks), raw)]):
                    for s, t, y in part:
                        pair = (R.KINDS[y], R.KINDS[judge.kind(s, t)])
                        counts[pair] = counts.get(pair, 0) + 1
                rows += [(key, *pair, n) for pair, n in counts.items()]
            columns = [*zip(*rows, strict=True)] or [()] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["fetch_id", "label", "predicted", "n"])

    judged = in_batches(fetched.select("fetch_id", "url", "bytes", "content_type"), run, "fetch_id bigint, label string, predicted string, n bigint")
    # repeated rows of a page count once
    return judged.dropDuplicates(["fetch_id", "label", "predicted"]).groupBy("label", "predicted").agg(F.sum("n").alias("sentences")).orderBy("label", "predicted")
