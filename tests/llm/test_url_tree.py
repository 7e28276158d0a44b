"""The path-template tree below wildcards, merged at every depth, and its fall back to parent and host."""

import pytest

from rillflow.llm import urltree

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def name(k):
    return LETTERS[k // 676 % 26] + LETTERS[k // 26 % 26] + LETTERS[k % 26]


@pytest.fixture(scope="module")
def judged(spark):
    urls, good = [], []

    def add(url, label):
        urls.append((len(urls), url))
        if label is not None:
            good.append((len(urls) - 1, label))

    for k in range(300):
        add(f"http://users.io/{name(k)}/{name(k * 7 + 5)}", False)  # all bad, each path once
        add(f"http://good.io/a/{name(k)}", True)
        add(f"http://good.io/a/{name(k)}/x/{name(k + 9)}", True)
        add(f"http://deep.io/{name(k)}/en/{'spam' if k % 2 else 'fine'}/{name(k * 3)}", k % 2 == 0)
    add("http://users.io/new/page", None)
    add("http://users.io/", None)
    add("http://users.io", None)
    add("http://deep.io/zzz/en/spam/qqq", None)
    got = urltree.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good boolean")).collect()
    assert len(got) == len(urls)
    by = dict(urls)
    return {by[r["page_id"]]: r for r in got}


def test_children_of_wildcards_become_wildcards(judged):
    users = [r for u, r in judged.items() if u.startswith("http://users.io/") and u.count("/") == 4]
    assert {(r["template"], r["verdict"]) for r in users} == {("*/*", "block")}
    assert {r["template"] for u, r in judged.items() if "/x/" in u} == {"a/*/x/*"}


def test_branches_without_labels_fall_back_to_the_host(judged):
    assert [judged[u]["verdict"] for u in ("http://users.io/new/page", "http://users.io/", "http://users.io")] == ["block"] * 3
    assert all(r["verdict"] == "allow" for u, r in judged.items() if "good.io" in u)


def test_branches_part_below_a_wildcard(judged):
    deep = {(r["template"], r["verdict"]) for u, r in judged.items() if "deep.io" in u}
    assert deep == {("*/en/spam/*", "block"), ("*/en/fine/*", "allow")}
