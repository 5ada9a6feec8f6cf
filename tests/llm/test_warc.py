import base64
import hashlib
import random

from gradewell.llm.warc import LoserTree, merged_index, read_archives, read_capture, url_key, write_archives

SCHEMA = "page_id long, url string, html string"


def test_loser_tree():
    rng = random.Random(6)
    for k in range(0, 12):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 30))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("https://www.Example.com:443/A/b?z=1&a=2#x") == "com,example)/a/b?a=2&z=1"
    assert url_key("http://m.a.org:8080") == "org,a,m:8080)/"
    assert url_key(None) == "none)/" and url_key("http://[bad")


def rows():
    rng = random.Random(2)
    out = [(i, f"http://h{rng.randrange(5)}.example.com/p{rng.randrange(9)}", f"<p>page {rng.randrange(30)} é</p>") for i in range(200)]
    return out + [(500, None, None), (501, "http://x\r\ny.com/ ü", ""), (None, "http://n.com", "<p>page 1 é</p>"),
                  (502, "http://big.com", "x" * 500_000), out[7]]


def expected(data, least=0):
    first = {}
    for i, _, h in data:
        if i is not None:
            b = (h or "").encode()
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in data:
        b = (h or "").encode()
        again = i is not None and len(b) >= least and first[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_round_trip(frame, tmp_path):
    data = rows()
    for least, name in ((0, "a"), (100, "b")):
        runs = write_archives(frame(data, SCHEMA), f"{tmp_path}/{name}", min_bytes=least, archive_bytes=2000)
        assert runs.select("file").distinct().count() > 3
        index = merged_index(runs)
        order = [(r.urlkey, r.captured, r.page_id is None, r.page_id or 0) for r in index.collect()]
        assert order == sorted(order) and len(order) == len(data)
        back = read_archives(index).collect()
        assert all(r.intact for r in back)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) \
            == expected(data, least)
    payload = {i: h for i, _, h in data}
    for r in index.collect()[:40]:
        got = read_capture(r)
        assert got["page_id"] == r.page_id
        if got["payload"] is not None and r.page_id is not None:
            assert got["payload"].decode() == (payload[r.page_id] or "")


def test_empty_table(frame, tmp_path):
    runs = write_archives(frame([], SCHEMA), f"{tmp_path}/e")
    assert read_archives(merged_index(runs)).count() == 0


def test_a_payload_of_a_third_of_all_pages(frame, tmp_path, monkeypatch):
    from gradewell.llm import warc
    monkeypatch.setattr(warc, "CELL_PAGES", 40)
    data = rows() + [(1000 + i, "http://e.com", None if i % 2 else "") for i in range(300)]
    back = read_archives(write_archives(frame(data, SCHEMA), f"{tmp_path}/h")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == expected(data)
