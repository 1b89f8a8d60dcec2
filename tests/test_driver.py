"""What runs on the driver: fetching, retries, jobs, prompts."""

import hashlib

import pytest

from skein.operators import extract
from skein.plans.jobs import Jobs, observed
from skein.sources import config, fetch


def test_fetch_roots_and_backoff():
    pages = {None: fetch.Page([{"ts": "3"}, {"ts": "2", "thread_ts": "1"}], "a"), "a": fetch.Page([{"ts": "1", "thread_ts": "1"}], None)}
    waits, fails = [], [fetch.RateLimited(7.0), fetch.RateLimited()]

    def page(cursor, size):
        if fails:
            raise fails.pop(0)
        return pages[cursor]

    got = fetch.fetch_roots(page, sleep=waits.append, jitter=0)
    assert got == ([{"ts": "3"}, {"ts": "1", "thread_ts": "1"}], None, False) and waits == [7.0, 2.0]
    assert fetch.fetch_roots(page, limit=1)[1:] == ("a", True)
    with pytest.raises(fetch.RateLimited):
        fetch.with_backoff(lambda: (_ for _ in ()).throw(fetch.RateLimited(1.0)), attempts=2, sleep=waits.append)


def test_fetch_after():
    every = [{"message_id": str(i)} for i in range(1, 8)]
    page = lambda last, size: [m for m in every if int(m["message_id"]) > last][:size]
    assert fetch.fetch_after(page, 2, page_size=2) == every[2:]
    assert fetch.fetch_after(page, 0, limit=3, page_size=2) == every[:3]


def test_land(tmp_path):
    a = fetch.land([{"ts": "1"}], tmp_path, "C")
    assert fetch.land([{"ts": "1"}], tmp_path, "C") == a and a.read_text() == '{"channel": "C", "ts": "1"}' and fetch.land([], tmp_path, "C") is None
    done, errors = fetch.each_channel(["a", "b"], lambda c: 1 // (c == "a"))
    assert done == {"a": 1} and len(errors) == 1 and errors[0].startswith("Channel b")


def test_retries():
    waits, kinds = [], ["rate", "timeout", "validation"]

    def call():
        if kinds:
            raise extract.CallFailed(kinds.pop(0))
        return "ok"

    assert extract.retrying(call, waits.append) == "ok" and waits == [10, 10, 6]
    with pytest.raises(extract.CallFailed):
        extract.retrying(lambda: (_ for _ in ()).throw(extract.CallFailed("auth")), waits.append)


def test_jobs(spark):
    jobs = Jobs({"count": lambda report, n: (report(2.0), observed(spark.range(n), "seen").count())[1], "bad": lambda report: 1 / 0})
    j = jobs.wait(jobs.submit("count", n=5))
    assert (j.status, j.result, j.progress) == ("done", 5, 1.0)
    assert jobs.wait(jobs.submit("bad")).status == "failed" and jobs.status("none") is None
    with pytest.raises(ValueError):
        jobs.submit("nothing")


def test_prompt(tmp_path):
    (tmp_path / "p.txt").write_text("say")
    assert config.load_prompt(tmp_path / "p.txt") == ("say", hashlib.sha256(b"say").hexdigest())
    (tmp_path / "e.txt").write_text(" ")
    with pytest.raises(ValueError):
        config.load_prompt(tmp_path / "e.txt")
