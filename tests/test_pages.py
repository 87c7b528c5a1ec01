"""HTML files with bytes that aren't UTF-8."""

import random

from skein.sources.pages import read_pages


def test_bad_bytes_go_and_written_ones_stay(spark, tmp_path):
    rng = random.Random(2)
    cases = {
        "plain": "<p>é中😀\r\n</p>".encode(),
        "replacement written": "a�b".encode(),
        "bad": b"a\xffb\xc3(\xe4\xb8c\xf0\x9f\x98",
        "both": b"x\xef\xbf\xbdy\xef\xbfz\xed\xa0\x80w",
        "overlong": b"\xc0\xafA\xf5\x80\x80\x80B",
        "empty": b"",
        **{f"r{i}": bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xEF, 0xBF, 0xBD]) for _ in range(30)) for i in range(60)},
    }
    for name, content in cases.items():
        (tmp_path / f"{name}.html").write_bytes(content)
    got = {r.doc: r.html for r in read_pages(spark, str(tmp_path)).collect()}
    assert got == {name: content.decode("utf-8", errors="ignore") for name, content in cases.items() if content}  # an empty file has no row
