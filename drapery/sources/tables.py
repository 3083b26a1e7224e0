"""Readers for the driver tables and the derived product views.

The derived views (``pt``, ``pp``, ``sp``, ``px``, ``st``, ``cl``) are the
test inputs of FIXTURES.md: product-shaped rows built with plain SQL from the
driver tables, so they grow with the scale factor. The same SQL text runs in
Spark (over ``parquet.`path``` relations) and in DuckDB (over its views).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

PT_SQL = """SELECT p_partkey AS product_id,
  concat(p_name, ' ', CASE p_partkey % 10 WHEN 0 THEN 'Harem Pant' WHEN 1 THEN 'Berkeley Hoodie' WHEN 2 THEN 'Wrap Dress' WHEN 3 THEN 'Linen Blazer'
    WHEN 4 THEN 'Fanny Pack Bag' WHEN 5 THEN 'Handmade Notes Journal' WHEN 6 THEN 'Women''s Yoga Jogger' WHEN 7 THEN 'Men''s Tank Top'
    WHEN 8 THEN 'Kids Merino Cardigan' ELSE 'Tie-Dye Romper' END) AS title,
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'Pants' ELSE 'Accessories' END AS product_type,
  CASE p_partkey % 7 WHEN 0 THEN 'black' WHEN 1 THEN 'Striped Navy' WHEN 2 THEN 'tie-dye rainbow' WHEN 3 THEN 'Floral' WHEN 4 THEN 'Zzyx' WHEN 5 THEN '' ELSE 'forest green' END AS color_name,
  CASE p_partkey % 18 WHEN 0 THEN '80% cotton, 20% linen' WHEN 1 THEN '100% Organic Cotton – Your new favorite hoodie'
    WHEN 2 THEN 'Wildflower/Marble: 80% cotton, 20% linenSolids: 100% cottonEasily worn' WHEN 3 THEN '40% OFF EVERY HAREM PANT'
    WHEN 4 THEN '95% Merino Wool, 5% elastane. Hand wash cold only.' WHEN 5 THEN 'Made in Nepal. 60% polyester; 40% viscose'
    WHEN 6 THEN '' WHEN 7 THEN '100% silk with a soft drape. Dry clean only.' WHEN 8 THEN '55% hemp, 45% organic cotton, GOTS certified'
    WHEN 9 THEN '100% Alpaca' WHEN 10 THEN '70% bamboo, 30% nylon' WHEN 11 THEN '100% lambswool' WHEN 12 THEN '100% Cashmere. Hand wash' WHEN 13 THEN '60% acrylic, 40% rayon'
    WHEN 14 THEN '100% European flax' WHEN 15 THEN '50% wool, 50% silk' WHEN 16 THEN '92% Modal, 8% Spandex' ELSE '100% Café cotton – “soft” & light' END AS materials,
  CASE WHEN p_partkey % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS price,
  CASE p_partkey % 6 WHEN 0 THEN '#0A0A0A' WHEN 1 THEN '#F5F5F0' WHEN 2 THEN '#FF8800' WHEN 3 THEN '2030C0' WHEN 4 THEN 'xyz' ELSE '#C0C020' END AS hex,
  'https://shop.example.com' AS base_url
FROM {part}"""

PP_SQL = """SELECT product_id AS page_id,
  concat('https://shop.example.com/products/', slug, CASE WHEN product_id % 4 = 0 THEN '?variant=1' ELSE '' END) AS url,
  concat('<html><head><title>', title, '</title><meta property="og:image" content="//cdn.example.com/products/', slug, '-1.jpg?v=9">',
    CASE WHEN product_id % 5 < 3 THEN concat('<script id="ProductJson-main" type="application/json">{"id":', CAST(product_id AS STRING), ',"title":"', title, '","type":"', product_type,
        '","description":"<p>', markup, '</p>","variants":[{"id":1,"option1":"black","price":', CAST(CAST(round(price * 100) AS BIGINT) AS STRING), ',"featured_image":{"src":"//cdn.example.com/products/', slug, '-1.jpg?v=9"}},{"id":2,"option1":"Striped Navy","price":0},{"id":3,"option1":"black","price":100},{"id":4,"title":"Default Title","price":100}]}</script>')
      WHEN product_id % 5 = 3 OR product_id % 25 IN (4, 9) THEN concat(CASE product_id % 25 WHEN 4 THEN '<script id="ProductJson-x" type="application/json">{"id":1,"title":"Broken","variants":[{"id":</script>' WHEN 9 THEN '<script id="ProductJson-x" type="application/json"> {} </script>' ELSE '' END, '<script type="application/ld+json">{"@type":"Product","name":"', title, '","sku":"SKU-', CAST(product_id AS STRING), '","description":"', markup, '","image":"https://cdn.example.com/products/', slug, '.jpg","offers":{"price":"19.99","priceCurrency":"EUR"}}</script>')
      ELSE '' END,
    '</head><body><h1 class="product__title">', title, '</h1><div class="product__media"><img src="//cdn.example.com/products/', slug, '-1.jpg?v=9"><img src="/assets/logo.png"><img data-src="/products/', slug, '-2.jpg"></div><p class="more"><img class="z" src="/products/', slug, '-3.jpg"></p><select class="size-picker"><option>XL</option><option>S</option><option>30</option></select><div class="care-notes">Machine wash cold.</div><div class="product__description">', markup,
    '</div><a href="/products/', slug, '-alt">more</a><a href="/pages/about">about</a><a href="../pages/./about?x=1&amp;y=2&copy=3">caf&eacute;</a><a href="//cdn.example.com/a/../b">cdn</a></body></html>') AS html
FROM (SELECT *, replace(replace(replace(replace(materials, '–', CASE product_id % 4 WHEN 0 THEN '&#8211;' WHEN 1 THEN '&ndash;' WHEN 2 THEN '&#x2013;' ELSE '–' END), ' & ', ' &amp; '), 'é', '&eacute;'), '“', '&ldquo;') AS markup,
  concat(replace(replace(lower(title), '''', ''), ' ', '-'), '-', CAST(product_id AS STRING)) AS slug FROM ({pt}) pt0) s"""

SP_SQL = """SELECT product_id AS page_id,
  concat('https://store.example.org/browse/product.do?pid=', CAST(500000 + product_id AS STRING), '&cid=5032') AS url,
  concat('<html><head><script>window.gap.properties.styles = {"', CAST(product_id AS STRING), '":{"displayName":"', color_name, '","images":[{"url":"/img/a', CAST(product_id AS STRING), '.jpg?x=1"}]},"z9":{"displayName":"navy"}};</script><script type="application/ld+json">{"@type":"Product","offers":{"price":"', CAST(product_id % 90 AS STRING), '.50","priceCurrency":"USD"}}</script></head><body><a class="breadcrumbs__crumb" href="/browse/womens-clothing/x">Sweaters</a><a data-href="/track" class="product-card__link" href="/browse/product.do?pid=', CAST(700000 + product_id AS STRING), '">next</a><h1 class="product-name">', title, '</h1><div class="product-details__description">', materials, '</div><div class="pdp-photo-single-column-image" data-imageurl="/img/h.jpg"><img src="/img/i.jpg"></div></body></html>') AS html
FROM ({pt}) pt1"""

PX_SQL = """SELECT l_partkey AS image_id, CAST((l_orderkey * 37 + l_linenumber) % 256 AS INT) AS r,
  CAST((l_partkey * 11) % 256 AS INT) AS g, CAST((l_orderkey + l_partkey) % 256 AS INT) AS b FROM {lineitem}"""

ST_SQL = """SELECT url, CASE WHEN page_id % 7 = 0 THEN md5('old') ELSE md5(html) END AS checksum,
  CASE page_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-08 00:00:00' ELSE TIMESTAMP '2024-01-14 00:00:00' END AS last_scraped
FROM {pages} WHERE page_id % 5 <> 0
UNION ALL SELECT url, md5('older') AS checksum, TIMESTAMP '2023-12-01 00:00:00' AS last_scraped FROM {pages} WHERE page_id % 10 = 1"""

CL_SQL = """SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS coll_idx, p_partkey % 10 + 1 AS page_no,
  CASE WHEN p_partkey % 17 = 3 THEN 404 ELSE 200 END AS status, CASE WHEN p_partkey % 23 = 5 THEN 120 ELSE 900 END AS body_len,
  concat('https://shop.example.com/products/item-', CAST(CAST(floor(p_partkey / 25) AS BIGINT) * 20 + p_partkey % 20 AS STRING)) AS product_url
FROM {part} WHERE p_partkey % 41 <> 13"""

VIEW_SQL = {"pt": PT_SQL, "pp": PP_SQL, "sp": SP_SQL, "px": PX_SQL, "st": ST_SQL, "cl": CL_SQL}
VIEW_DEPS = {"pp": ["pt"], "sp": ["pt"]}


def _render(name: str, rel) -> str:
    """Fill a view's placeholders with relation names produced by ``rel``."""
    sql = VIEW_SQL[name]
    subs = {t: rel(t) for t in TABLES}
    for dep in VIEW_DEPS.get(name, []):
        subs[dep] = _render(dep, rel)
    for key, val in subs.items():
        sql = sql.replace("{" + key + "}", val)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Spark prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Views that ``write_views`` has written, by folder and name.
WRITTEN: dict[tuple[str, str], str] = {}


def write_views(spark: SparkSession, sf_dir: str, names=("pp", "sp", "pv"), files: int = 32) -> None:
    """Write views as tables of ``files`` files, which ``view`` reads from then on.

    The driver tables have one file and one row group each, so that a view over
    them is a single task; pages in a store come in many files."""
    for name in names:
        path = scratch_path(spark, f"view-{name}")
        view(spark, sf_dir, name).repartition(files).write.parquet(path)
        WRITTEN[sf_dir.rstrip("/"), name] = path


#: Rows a task builds pages of (a page is one or two KB).
SPREAD_ROWS = 2000
#: Views whose rows are spread before they are built, and the columns these read of ``part``.
SPREAD_VIEWS, PART_COLUMNS = ("pt", "pp", "sp", "pv"), "p_partkey, p_name, p_retailprice"


def _spread_part(spark: SparkSession, relation: str) -> str:
    """``part``, dealt over tasks of ``SPREAD_ROWS`` rows.

    The table may be one file of one row group, and would then be read, built
    into pages and parsed by a single task at any size. The narrow rows are
    dealt, not the pages; ``inline`` keeps filters on what is built from them
    above the shuffle. The rows are counted from the files' footers."""
    tasks = -(-spark.sql(f"SELECT 1 FROM {relation}").count() // SPREAD_ROWS)
    if tasks <= 1:
        return relation
    return (f"(SELECT inline(array(struct({PART_COLUMNS}))) FROM "
            f"(SELECT /*+ REPARTITION({tasks}) */ {PART_COLUMNS} FROM {relation}))")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived fixture view: over the parquet files, or as written before."""
    base = sf_dir.rstrip("/")
    if (base, name) in WRITTEN:
        return spark.read.parquet(WRITTEN[base, name])

    def relation(t):
        return f"parquet.`{base}/{t}.parquet`"

    part = _spread_part(spark, relation("part")) if name in SPREAD_VIEWS else relation("part")
    return spark.sql(_render(name, lambda t: part if t == "part" else relation(t)))


def duckdb_view_sql(name: str) -> str:
    """The same view for DuckDB, whose tables are pre-registered views."""
    return _render(name, lambda t: t)


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with ``WITH`` clauses for the named fixture views."""
    ctes = ",\n".join(f"{n} AS ({duckdb_view_sql(n)})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql


PV_SQL = """SELECT product_id AS page_id,
  CASE WHEN product_id % 2 = 0 THEN concat('https://shop.example.com/products/', slug)
       ELSE concat('https://store.example.org/browse/product.do?pid=', CAST(600000 + product_id AS STRING), '&cid=', CASE WHEN product_id % 4 = 1 THEN '5032' ELSE '77' END) END AS url,
  concat('<html><head><title>', title, '</title>',
    CASE WHEN product_id % 4 <> 3 THEN concat('<meta property="product:price:amount" content="', CAST(price AS STRING), '"><meta property="product:price:currency" content="', CASE WHEN product_id % 2 = 0 THEN 'USD' ELSE 'EUR' END, '">') ELSE '' END,
    '<meta property="og:image" content="//cdn.example.com/products/', slug, '-og.jpg?v=2">',
    CASE WHEN product_id % 3 = 0 THEN concat('<script type="application/json">{"variants":[{"title":"', color_name, ' / S","featured_image":{"src":"//cdn.example.com/products/', slug, '-a.jpg?v=1"}},{"title":"', color_name, ' / M"},{"title":"Navy / S","featured_image":{"src":"/assets/logo.png"}},{"title":"Default"}]}</script>')
         WHEN product_id % 3 = 1 THEN '<script type="application/json">{"variants":[{"title":"Default Title"}]}</script>' ELSE '' END,
    CASE WHEN product_id % 3 = 1 THEN concat('<script>window.gap.properties.styles = {"', CAST(product_id AS STRING), '":{"displayName":"', color_name, '","copy_headers":[{"id":"overview","label":"Overview","bullets":["Relaxed fit"]},{"id":"fabric","label":"Fabric","bullets":["', materials, '","Imported"]}]}};</script>')
         WHEN product_id % 3 = 2 THEN concat('<script>window.gap.properties.styles = {"', CAST(product_id AS STRING), '":{"displayName":"', color_name, '","copy_headers":[{"id":"care","label":"Fabric & care","bullets":["Machine wash cold","', materials, '"]}]},"z8":{"displayName":"sand"}};</script>') ELSE '' END,
    '</head><body><h1 class="product__title">', title, '</h1><span class="price">',
    CASE product_id % 4 WHEN 0 THEN concat('$', CAST(price AS STRING)) WHEN 1 THEN concat(CAST(price AS STRING), ' EUR') WHEN 2 THEN 'Sold out' ELSE concat('£', CAST(product_id AS STRING), '.50') END, '</span>',
    CASE product_id % 5 WHEN 0 THEN concat('<div data-colorname="', color_name, '">swatch</div>') WHEN 1 THEN '<span class="colorName">$19.99</span>'
         WHEN 2 THEN '<button data-colorname="Olive">o</button><button data-colorname="Rust Red">r</button><button data-colorname="Olive">o</button>' ELSE '' END,
    '<div class="product__media"><img srcset="/products/', slug, '-s1.jpg 1x, /products/', slug, '-s2.jpg 2x"><img src="/assets/logo.png"></div>',
    '<div class="pdp-photo-single-column-image" data-imageurl="/img/', CAST(product_id AS STRING), '-1.jpg"><img src="/img/x.jpg"></div><div class="pdp-photo-single-column-image"><img src="/img/', CAST(product_id AS STRING), '-2.jpg"></div>',
    CASE WHEN product_id % 2 = 1 THEN concat('<ul class="product-information-item__list"><li>', markup, '</li><li>ab</li><li>Imported</li></ul>') ELSE '' END,
    '<div class="product__description">', markup, '</div></body></html>') AS html
FROM (SELECT *, replace(replace(replace(replace(materials, '–', CASE product_id % 4 WHEN 0 THEN '&#8211;' WHEN 1 THEN '&ndash;' WHEN 2 THEN '&#x2013;' ELSE '–' END), ' & ', ' &amp; '), 'é', '&eacute;'), '“', '&ldquo;') AS markup,
  concat(replace(replace(lower(title), '''', ''), ' ', '-'), '-', CAST(product_id AS STRING)) AS slug FROM ({pt}) pt2) s"""

VIEW_SQL["pv"] = PV_SQL
VIEW_DEPS["pv"] = ["pt"]
