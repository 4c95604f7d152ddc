import base64
import collections
import glob
import gzip
import hashlib
import random
import tempfile
import zlib

import pytest

from shroud.llm import url_filter, warc


@pytest.fixture(scope="module")
def odd_pages(spark):
    body = "<p>" + "é" * 80 + "</p>"
    crlf = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9
    rows = [(3, "http://Sub.Example.ORG:80/en/17?q#f", body), (1, "https://example.org/es/x", body), (2, "http://a.com/fr/", body), (2, "http://a.com/fr/", body),
            (4, None, None), (5, "no scheme/", ""), (6, "http://", "tiny"), (7, "http://x?/en/1", "tiny"), (None, "http://org/", body), (8, "x://y://com/fr/", crlf),
            (9, "http://com/de/\r\nInjected: yes", crlf), (10, "http://a..org/", "z" * 3_000_000), (11, "http://notexample.org/es/", None), (12, "http://example.org", "q" * 99)]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id bigint, url string, html string, host string, digest int")


def brute_judge(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls_equal_brute_force(spark, odd_pages):
    rows = url_filter.judge(odd_pages, url_filter.rules_frame(spark)).collect()
    want = collections.Counter((r.page_id, *brute_judge(r.url)) for r in odd_pages.collect())
    assert collections.Counter(tuple(r) for r in rows) == want
    assert url_filter.judge(odd_pages.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_rule_precedence_and_no_rules(spark, odd_pages):
    rules = [("b.com", "/x", "allow"), ("a.b.com", "/", "block"), ("b.com", "/x/y", "block"), ("b.com", "/x/y", "allow"), ("com", "", "block")]
    pages = spark.createDataFrame([(1, "http://a.b.com/x"), (2, "http://b.com/x"), (3, "http://b.com/x/y/z"), (4, "http://q.com"), (5, "http://q.net/")], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_frame(spark, rules)).collect()}
    assert got == {1: ("a.b.com/", "block"), 2: ("b.com/x", "allow"), 3: ("b.com/x/y", "block"), 4: ("com", "block"), 5: (None, "allow")}
    none = url_filter.judge(odd_pages, url_filter.rules_frame(spark, []), default="block").collect()
    assert len(none) == odd_pages.count() and {r.verdict for r in none} == {"block"}


def archived(spark, pages, **options):
    path = tempfile.mkdtemp(prefix="shroud-warc-") + "/a"
    warc.write_archives(pages, path, **options)
    return path


def test_archives_round_trip(spark, odd_pages):
    path = archived(spark, odd_pages, file_bytes=2000)
    captures = warc.assemble(warc.read_records(spark, path)).collect()
    pages = odd_pages.collect()
    assert len(captures) == len(pages)
    assert all(len(c.requests) == 1 and len(c.metadata) == 1 for c in captures)
    stored = collections.Counter(bytes(c.response.payload).decode() for c in captures if c.response.warc_type == "response")
    assert set(stored) == {r.html or "" for r in pages}


def test_digests_revisits_and_odd_rows(spark, odd_pages):
    rows = warc.resolve_revisits(warc.assemble(warc.read_records(spark, archived(spark, odd_pages), with_payload=False))).collect()
    pages = [(r.page_id, (r.html or "").encode()) for r in odd_pages.collect()]
    first = {}
    for i, b in pages:
        if i is not None and len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    want = collections.Counter()
    for i, b in pages:
        revisit = len(b) >= 100 and first[b] != i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want


def members_of(content):
    """The uncompressed gzip members of a file."""
    out = []
    while content.strip(b"\0"):
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return out


def test_a_member_a_record_behind_a_file_record(spark, odd_pages):
    rows = [(i, f"http://x/{i}", random.Random(i).randbytes(900).hex()) for i in range(200)] + [(500, "http://big/", "z" * 17_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2)
    files = [open(f, "rb").read() for f in glob.glob(archived(spark, pages, file_bytes=20_000) + "/part-*")]
    assert len(files) > 8 and max(map(len, files)) < 20_000 + 18_000  # one record more, here at most the large one
    members = [members_of(f) for f in files]
    for file in members:
        assert b"WARC-Type: warcinfo" in file[0] and not any(b"WARC-Type: warcinfo" in m for m in file[1:])
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and len(list(warc.parse_records(m))) == 1 for m in file)
    assert sum(map(len, members)) == 3 * len(rows) + len(files)


def test_revisits_name_the_stored_record(spark):
    body = "b" * 200
    pages = spark.createDataFrame([(i, f"http://x/{i}", body) for i in (7, 4, 9)] + [(1, "http://y/", "c" * 200)] * 2 + [(2, "http://y/", "c" * 200)],
                                  "page_id bigint, url string, html string")
    rows = warc.read_records(spark, archived(spark, pages)).where("warc_type in ('response', 'revisit')").collect()
    ids = {r.record_id: r for r in rows}
    assert len(ids) == len(rows) == 6
    named = {r.target_uri: ids[r.refers_to].target_uri for r in rows if r.refers_to}
    assert named == {"http://x/7": "http://x/4", "http://x/9": "http://x/4"}  # two records of page 1 are stored: none is named
    assert [r.digest_ok for r in rows if r.warc_type == "response"] == [True] * 3


def test_changed_payloads_show(spark, tmp_path):
    def record(digest, payload=b"abcd"):
        return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: " + digest + b"\r\nContent-Length: %d\r\n\r\n" % (
            len(payload) + 19) + b"HTTP/1.1 200 OK\r\n\r\n" + payload + b"\r\n\r\n"
    sha1, sha256 = hashlib.sha1(b"abcd").digest(), hashlib.sha256(b"abcd").hexdigest().encode()
    digests = [b"sha256:" + sha256, b"SHA-256:" + sha256.upper(), b"sha1:" + base64.b32encode(sha1), b"sha1:" + base64.b32encode(b"0" * 20), b"tiger:abc", b""]
    (tmp_path / "a.warc").write_bytes(b"".join(map(record, digests)) + record(digests[0], b"abce"))
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert [r.digest_ok for r in rows] == [True, True, True, False, None, None, False]


def test_empty_table(spark, odd_pages):
    path = archived(spark, odd_pages.limit(0))
    assert warc.resolve_revisits(warc.assemble(warc.read_records(spark, path))).count() == 0


def test_damaged_archives():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in warc.parse_records(record + b"noise\r\n" + record)] == [b"abcd"] * 2
    assert [b for _, b in warc.parse_records(record + record[:-6])] == [b"abcd"]
    assert [b for _, b in warc.parse_records(gzip.compress(record) + gzip.compress(record))] == [b"abcd"] * 2  # a member a record
    assert len(list(warc.parse_records(gzip.compress(record * 3)[:-12]))) <= 3
    assert list(warc.parse_records(b"")) == []


def test_links_in_either_direction(spark):
    def row(i, kind, to=()):
        return (i, kind, None, list(to), None, None, 0, None, None, {}, None)
    records = [row("r1", "response", ["q1"]), row("q1", "request"), row("m1", "metadata", ["r1"]), row("m2", "metadata", ["r1"]),
               row("r2", "revisit"), row("q2", "request", ["r2", "gone"]), row("lost", "metadata", ["gone"])]
    got = warc.assemble(spark.createDataFrame(records, warc.RECORD_SCHEMA)).collect()
    names = {c.response.record_id: ([q.record_id for q in c.requests], sorted(m.record_id for m in c.metadata)) for c in got}
    assert names == {"r1": (["q1"], ["m1", "m2"]), "r2": (["q2"], [])}


def test_archives_of_other_names_and_files_that_end_early(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "crawl-00001.warc.gz").write_bytes(gzip.compress(record) * 2)
    (tmp_path / "plain.warc").write_bytes(record + record[:-6])
    (tmp_path / "part-0.gz").write_bytes(gzip.compress(record) + gzip.compress(record)[:-12])
    (tmp_path / "notes.txt").write_bytes(record)
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert sum(r.warc_type == "response" for r in rows) >= 4
    cut = sorted(r.target_uri.rsplit("/", 1)[1] for r in rows if r.warc_type == warc.CUT_OFF)
    assert cut == ["part-0.gz", "plain.warc"]
    assert warc.read_records(spark, str(tmp_path), names="*.txt").count() == 1
