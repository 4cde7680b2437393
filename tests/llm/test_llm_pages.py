"""Extraction from the given pages with other class names, other wrappers, marks inside articles and boilerplate beside them."""

import re
from collections import Counter

import pytest

from lithoframe.llm import html

MORE = "Buy this now it is very cheap and good for you and your family too."


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").limit(120).collect()]


def article(page, made):
    return re.sub(r"<article>(.*)</article>", lambda m: made(m[1]), page, flags=re.S)


CASES = {
    "advert under another name": (lambda p: p.replace('class="ad"', 'class="zq1"'), True, 1.0),
    "marks inside": (lambda p: article(p, lambda b: f'<article><div class="social-impact">{b.replace("<p>", "<p class=notice-text>", 2)}</div></article>'), False, 1.0),
    "marks inside an unmarked article": (lambda p: article(p, lambda b: f'<div>{b.replace("<p>", "<p class=notice-text>", 2)}</div>'), False, 0.99),
    "column beside": (lambda p: article(p, lambda b: f'<article>{b}</article><div class="col2"><p>{MORE}</p></div>'), False, 1.0),
    "column beside an unmarked article": (lambda p: article(p, lambda b: f'<div class="col1">{b}</div><div class="col2"><p>{MORE}</p><p>{MORE}</p></div>'), False, 0.95),
    "responses inside": (lambda p: article(p, lambda b: f'<article>{b}<section id="responses"><h2>2 replies</h2><div class="c"><p>{MORE}</p></div></section></article>'), False, 1.0),
    "advert inside": (lambda p: article(p, lambda b: f'<article>{b.replace("</p><p>", f"</p><div class=ad-slot>{MORE}</div><p>", 1)}</article>'), False, 1.0),
    "notice before": (lambda p: p.replace("<article>", '<div class="cookie-notice"><p>We use cookies and say so.</p></div><article>'), False, 1.0),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name, pages):
    change, again, precision = CASES[name]
    weights = html.train(pages[:60])
    want = [Counter(html.extract(p, weights).split()) for p in pages[60:]]
    used = html.train([change(p) for p in pages[:60]]) if again else weights
    got = [Counter(html.extract(change(p), used).split()) for p in pages[60:]]
    same = [sum((a & b).values()) for a, b in zip(got, want, strict=True)]
    assert same == [sum(b.values()) for b in want], "article text is lost"
    assert sum(same) >= precision * sum(sum(a.values()) for a in got)
