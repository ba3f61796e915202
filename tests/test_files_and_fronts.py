import json
import threading
import urllib.error
import urllib.request

import pytest

from tidemark import cli, serve
from tidemark.operators import layers
from tidemark.operators.store import Store
from tidemark.sources import segment_file as sf


def test_golden_entries():
    data = sf.encode([(b"k1", None), (b"k2", b"v2")])
    assert data.startswith(bytes.fromhex("020000006b31ffffffff" + "020000006b32020000007632"))
    assert list(sf.entries(data)) == [(b"k1", None), (b"k2", b"v2")] and sf.footer(data)[4:] == (6, 2) and sf.index(data) == [(b"k1", 0)]


def test_round_trip_and_index():
    rows = [(f"key-{i:08d}".encode(), None if i % 5 == 0 else b"v" * (i % 7)) for i in range(100)]
    data = sf.encode(rows)
    assert list(sf.entries(data)) == rows and [k for k, _ in sf.index(data)] == [rows[i][0] for i in range(0, 100, 16)]
    for key, at in sf.index(data):
        assert data[at + 4 : at + 4 + len(key)] == key


@pytest.mark.parametrize("n,fits", [(4, True), (6, True), (8, True), (101, False), (7, False)])
def test_filters_that_do_not_fit_once_reopened(n, fits):
    assert sf.filter_fits(sf.encode([(f"key-{i:08d}".encode(), b"") for i in range(n)])) is fits


@pytest.mark.parametrize("data", [b"", b"x" * 39, b"\xff" * 60])
def test_bad_files(data):
    with pytest.raises(sf.SegmentError):
        list(sf.entries(data))
    good = sf.encode([(b"a", b"1"), (b"b", b"2")])
    with pytest.raises(sf.SegmentError):
        list(sf.entries(b"\xff" + good[1:]))
    with pytest.raises(sf.SegmentError):
        sf.encode([(b"b", b""), (b"a", b"")])


def test_import_into_a_store(spark, tmp_path):
    (tmp_path / "1.sst").write_bytes(sf.encode([(b"a", b"1"), (b"b", None)]))
    rows = sf.read(spark, str(tmp_path)).selectExpr("1L as seq", "key", "op", "value")
    store = Store(spark, str(tmp_path / "store"))
    store.ingest(rows)
    assert store.get("a") == (b"1", True) and store.get("b") == (None, True) and store.get("c") == (None, False)


def test_exact_flushes_follow_overwrites(spark):
    rows = [(0, i, k, "x" * 9) for i, k in enumerate("aaabcaa")] + [(1, 9, "z", None)]
    df = spark.createDataFrame(rows, "store long, seq long, key string, value string")
    got = sorted(map(tuple, layers.exact_flushes(df, 30).collect()))
    assert got == [(0, 0, 0, 4, 3, 30), (0, 1, 5, 6, 1, 10), (1, 0, 9, 9, 1, 1)]


def test_command_line(spark, tmp_path, capsys):
    lines = iter(["put a some value", "GET a", "del a", "get a", "status", "help", "nonsense", "put a", "quit"])
    cli.main(lambda: next(lines), [str(tmp_path)])
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "ok 1" and out[1] == "some value" and out[2] == "deleted 2" and out[3] == "(nil)" and json.loads(out[4])["last_seq"] == 2 and out[6].startswith("usage") and out[7].startswith("usage")


def test_http(spark, tmp_path):
    s = serve.server(Store(spark, str(tmp_path)))
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", body, method=method)
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("PUT", "/api/kv/a/b%20c", b'{"value":"x"}') == (200, {"status": "ok", "key": "a/b c"})
        assert ask("GET", "/api/kv/a/b%20c") == (200, {"key": "a/b c", "value": "x"})
        assert ask("DELETE", "/api/kv/a/b%20c")[0] == 200 and ask("GET", "/api/kv/a/b%20c")[0] == 404
        assert ask("PUT", "/api/kv/e", b'{"value":""}')[0] == 200 and ask("GET", "/api/kv/e") == (200, {"key": "e", "value": ""})
        assert [ask("PUT", "/api/kv/k", b)[0] for b in (b"{", b'{"value":3}', b"[1]")] == [400, 400, 400]
        assert ask("GET", "/api/kv/")[0] == 400 and ask("POST", "/api/kv/k")[0] == 405 and ask("GET", "/api/status")[1]["last_seq"] == 3
    finally:
        s.shutdown()
