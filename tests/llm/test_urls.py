"""The whole URL query against its SQL, on pages that do declare canonical links and redirects."""

import random

import pytest

from guardlake.llm import urls
from oracle import check

HOSTS = ("a.com", "b.a.com", "x.org", "example.org", "deep.example.org", "q.net", "shop.com")
PATHS = ("/", "/fr/1", "/de/1", "/de/22", "/es/p", "/en/1", "/en/12", "/x/y", "/x/z?q=1", "/r#top")
FORMS = (
    '<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', "<META HTTP-EQUIV=refresh content='5;URL={}'>",
    "<p>no link to {}</p>", '<link rel="stylesheet" href="{}">',
)


@pytest.mark.parametrize("seed", [1, 2])
def test_aliases_equal_sql(spark, tmp_path, seed):
    rng = random.Random(seed)
    address = lambda g: f"http{rng.choice(['', 's'])}://{rng.choice(HOSTS)}{rng.choice(PATHS)}{g}"
    target = lambda g: rng.choice([address(g), "//" + address(g).split("//")[1], f"{rng.choice(PATHS)}{g}", ""])
    # islands of pages that link among themselves
    rows = [(i, address(i // 5), "<html>" + "".join(rng.choice(FORMS).format(target(i // 5)) for _ in range(rng.randrange(3)))) for i in range(250)]
    rows += [(900, None, None), (901, "nothing", "x"), (902, "http://a.com/de/1", None), (902, "http://a.com/de/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    (tmp_path / "all").mkdir()
    pages.toPandas().to_parquet(tmp_path / "all" / "pages.parquet")
    check(spark, urls.op2_urls, urls.oracle(), str(tmp_path / "all"), ("pages",))
    plain = urls.filter_urls(pages, html_col=None).where("verdict = 'block'").count()
    assert urls.op2_urls(spark, str(tmp_path / "all")).where("verdict = 'block'").count() > plain
