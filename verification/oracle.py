"""The queries of ``verification.queries`` in ANSI SQL, composed from named common table expressions."""

NOW = "2024-06-01 12:00:00"

RAW = """raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cont_id, CAST(o_orderkey AS VARCHAR) AS transaction_id,
         o_orderdate AS transaction_date, CAST(l_partkey AS VARCHAR) AS prod_id,
         p_brand AS prod_family, p_type AS prod_subfamily,
         p_name || '#' || CAST(p_partkey AS VARCHAR) AS prod_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

CATS = """cats AS (
  SELECT category1, category1 || '/' || prod_family AS category2, prod_family, prod_subfamily FROM (
    SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'L' WHEN 'LARGE' THEN 'D' WHEN 'MEDIUM' THEN 'B'
                                WHEN 'PROMO' THEN 'A' WHEN 'SMALL' THEN 'O' END AS category1,
           p_brand AS prod_family, p_type AS prod_subfamily
    FROM part WHERE p_type <> 'STANDARD'))"""

LABEL = """CASE category1 WHEN 'L' THEN 'LIVING ROOM' WHEN 'D' THEN 'DINING ROOM'
  WHEN 'B' THEN 'BEDROOM' WHEN 'A' THEN 'ACCESSORIES' WHEN 'O' THEN 'OTHER' END"""

F5 = """f5 AS (SELECT * FROM raw WHERE cont_id IN (
  SELECT cont_id FROM raw GROUP BY cont_id HAVING count(DISTINCT transaction_id) >= 6))"""
F7 = """f7 AS (SELECT * FROM f5 WHERE prod_name IN (
  SELECT prod_name FROM f5 GROUP BY prod_name HAVING count(DISTINCT transaction_id) >= 25))"""
F8 = """f8 AS (SELECT * FROM f7 WHERE prod_name IN (
  SELECT prod_name FROM f7 GROUP BY prod_name HAVING max(transaction_date) > TIMESTAMP '2001-04-01'))"""
X2 = "x2 AS (SELECT DISTINCT * FROM f8)"

INBOX = [RAW, CATS, F5, F7, F8, X2, f"""known AS (
  SELECT x2.*, cats.category1, cats.category2, {LABEL} AS "CAT1"
  FROM x2 JOIN cats USING (prod_family, prod_subfamily))""", """models AS (
  SELECT prod_family, prod_subfamily, prod_name,
         row_number() OVER (ORDER BY prod_family, prod_subfamily, prod_name) AS model_id
  FROM (SELECT DISTINCT prod_family, prod_subfamily, prod_name FROM known))""", """inbox AS (
  SELECT known.*, model_id FROM known JOIN models USING (prod_family, prod_subfamily, prod_name))"""]

ROWS = INBOX + ["""rows AS (SELECT * FROM inbox
  WHERE NOT contains(lower(prod_name), 'old') AND NOT contains(lower(prod_name), 'gizmo'))"""]

MENU = INBOX + [f"""firsts AS (
  SELECT prod_name, prod_family, prod_subfamily FROM (
    SELECT *, row_number() OVER (PARTITION BY prod_name
      ORDER BY transaction_date, transaction_id, prod_family, prod_subfamily) AS rn FROM x2)
  WHERE rn = 1)""", f"""menu AS (
  SELECT {LABEL} AS "CAT1", prod_family, prod_subfamily, prod_name
  FROM firsts JOIN cats USING (prod_family, prod_subfamily))"""]

REQUESTS = """requests AS (
  SELECT client_id, n // 3 AS form, CAST(n % 3 + 1 AS INTEGER) AS pos,
         p_name || '#' || CAST(p_partkey AS VARCHAR) AS prod_name FROM (
    SELECT CAST(user_id AS VARCHAR) AS client_id,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n,
           event_id % (SELECT count(*) FROM part) AS partkey
    FROM events WHERE event_type = 'purchase') e
  JOIN part ON partkey = p_partkey)"""

FEEDBACK = ROWS + [REQUESTS, """lookup AS (
  SELECT DISTINCT prod_family, prod_subfamily, prod_name, "CAT1", category1, category2, model_id
  FROM rows)""", f"""suggestions AS (
  SELECT client_id AS cont_id, 'suggestion' AS transaction_id, TIMESTAMP '{NOW}' AS transaction_date,
         CAST(NULL AS VARCHAR) AS prod_id, prod_family, prod_subfamily, prod_name, "CAT1",
         category1, category2, model_id
  FROM (SELECT r.client_id, l.*, n_given,
               row_number() OVER (PARTITION BY r.client_id, r.form ORDER BY model_id) AS rn
        FROM (SELECT DISTINCT client_id, form, prod_name FROM requests) r
        JOIN (SELECT client_id, form, count(*) AS n_given FROM requests GROUP BY 1, 2) g
             USING (client_id, form)
        JOIN lookup l USING (prod_name))
  WHERE rn <= n_given)""", """fed AS (SELECT * FROM rows UNION ALL BY NAME SELECT * FROM suggestions)"""]


def grid(x, digits=8):
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def cosine_distance(dot):
    return grid(grid(f"greatest(1.0 - {dot}, 0.0)", 12))


def counts(src, name="counts"):
    return (f"{name} AS (SELECT cont_id, prod_name, count(*) AS cnt FROM {src} "
            "WHERE prod_name <> 'nan' GROUP BY cont_id, prod_name)")


def weights(src, p=""):
    return [counts(src, f"counts{p}"), f"""bounds{p} AS (
  SELECT prod_name, CASE WHEN count(*) = (SELECT count(DISTINCT cont_id) FROM counts{p})
         THEN min(cnt) ELSE 0 END AS low, max(cnt) AS high FROM counts{p} GROUP BY prod_name)""",
            f"""weights{p} AS (
  SELECT cont_id, prod_name, CASE WHEN high > low
         THEN CAST(cnt - low AS DOUBLE) / CAST(high - low AS DOUBLE) ELSE 0.0 END AS weight
  FROM counts{p} JOIN bounds{p} USING (prod_name))"""]


def unit(p=""):
    return [f"""unit{p} AS (
  SELECT cont_id, prod_name, weight / sqrt(sum(weight * weight) OVER (PARTITION BY cont_id)) AS u
  FROM weights{p} WHERE weight > 0)"""]


def user_nn(src, k=10):
    return weights(src) + unit() + [f"""nn AS (
  SELECT cont_id, neighbor_id, dist,
         row_number() OVER (PARTITION BY cont_id ORDER BY dist, neighbor_id) AS neighbor_rank
  FROM (SELECT a.cont_id, b.cont_id AS neighbor_id, {cosine_distance('sum(a.u * b.u)')} AS dist
        FROM unit a JOIN unit b USING (prod_name) GROUP BY a.cont_id, b.cont_id)
  QUALIFY neighbor_rank <= {k})"""]


def item_nn(src, weight="cnt * cnt", k=10):
    return [counts(src), f"""iw AS (SELECT cont_id, prod_name, CAST({weight} AS DOUBLE) AS weight FROM counts)""",
            """iu AS (SELECT cont_id, prod_name,
         weight / sqrt(sum(weight * weight) OVER (PARTITION BY prod_name)) AS u FROM iw)""", f"""inn AS (
  SELECT prod_name, neighbor_id, dist,
         row_number() OVER (PARTITION BY prod_name ORDER BY dist, neighbor_id) AS neighbor_rank
  FROM (SELECT a.prod_name, b.prod_name AS neighbor_id, {cosine_distance('sum(a.u * b.u)')} AS dist
        FROM iu a JOIN iu b USING (cont_id) GROUP BY a.prod_name, b.prod_name)
  QUALIFY neighbor_rank <= {k})"""]


def orders(src, order="transaction_id"):
    return [f"""split AS (
  SELECT cont_id, transaction_id, order_no, n_orders,
         CASE WHEN order_no <= (2 * n_orders) // 3 THEN 'history' ELSE 'target' END AS part
  FROM (SELECT cont_id, transaction_id,
               row_number() OVER (PARTITION BY cont_id ORDER BY {order}) AS order_no,
               count(*) OVER (PARTITION BY cont_id) AS n_orders
        FROM (SELECT cont_id, transaction_id, min(transaction_date) AS order_date
              FROM {src} GROUP BY cont_id, transaction_id)))"""]


def targets(src):
    return [f"""targets AS (
  SELECT cont_id AS neighbor_id, prod_name, count(*) AS cnt
  FROM {src} JOIN (SELECT cont_id, transaction_id FROM split WHERE part = 'target')
       USING (cont_id, transaction_id) GROUP BY 1, 2)"""]


def picks(vote="last", n=5):
    score = {"last": "max_by(cnt, neighbor_rank)", "sum": "CAST(sum(cnt) AS BIGINT)"}[vote]
    return [f"""picks AS (
  SELECT cont_id, prod_name, score,
         row_number() OVER (PARTITION BY cont_id ORDER BY score DESC, first_rank, prod_name) AS rank
  FROM (SELECT cont_id, prod_name, {score} AS score, min(neighbor_rank) AS first_rank
        FROM nn JOIN targets USING (neighbor_id) GROUP BY cont_id, prod_name)
  QUALIFY rank <= {n})"""]


def by_customers(src="rows", vote="last", n=5):
    return user_nn(src) + orders(src) + targets(src) + picks(vote, n)


def by_products(src="rows", weight="cnt * cnt", seed="top1", order="prod_name", past=None):
    past = past or src
    seeds = "iw" if seed == "all" else """(SELECT * FROM iw QUALIFY row_number() OVER (
      PARTITION BY cont_id ORDER BY weight DESC, prod_name) = 1)"""
    return item_nn(src, weight) + orders(past) + [f"""picks AS (
  SELECT cont_id, prod_name, dist, row_number() OVER (PARTITION BY cont_id ORDER BY {order}) AS rank
  FROM (SELECT s.cont_id, inn.neighbor_id AS prod_name, min(inn.dist) AS dist
        FROM {seeds} s JOIN inn USING (prod_name) GROUP BY 1, 2) c
  WHERE NOT EXISTS (SELECT 1 FROM {past} r JOIN split o USING (cont_id, transaction_id)
                    WHERE o.part = 'history' AND r.cont_id = c.cont_id AND r.prod_name = c.prod_name))"""]


def gated(src="rows"):
    return [f"""variants AS (
  SELECT prod_name, prod_family, prod_subfamily, category1, category2, "CAT1", model_id,
         count(*) AS n_rows FROM {src} GROUP BY ALL)""", """shown AS (
  SELECT cont_id, rank, v.* FROM picks JOIN variants v USING (prod_name))""", """gated AS (
  SELECT s.* FROM shown s JOIN (
    SELECT cont_id, count(DISTINCT CASE WHEN category1 IN ('L', 'D', 'B') THEN "CAT1" END) AS core
    FROM shown GROUP BY cont_id) USING (cont_id)
  WHERE category1 IN ('L', 'D', 'B') OR (core <> 3 AND category1 = 'A'))"""]


SERVING_ORDER = "category1 DESC, rank, prod_name, model_id"


def served(order=SERVING_ORDER):
    return f"""SELECT cont_id, row_number() OVER (PARTITION BY cont_id ORDER BY {order}) AS position,
       "CAT1", category1, prod_family, prod_subfamily, prod_name, model_id
FROM (SELECT * FROM gated QUALIFY row_number() OVER (PARTITION BY cont_id, "CAT1" ORDER BY {order}) = 1)"""


def unrolled(group, n):
    """Purchase rows of the gated products, the first n of each group."""
    return [f"""placed AS (
  SELECT * FROM gated, range(1, {n} + 1) t(place) WHERE place <= n_rows
  QUALIFY row_number() OVER (PARTITION BY cont_id, {group} ORDER BY {SERVING_ORDER}, place) <= {n})"""]


def wide(src, prefix):
    cols = ", ".join(
        f"coalesce(max(CASE WHEN position = {i} THEN prod_name END), ' ') AS {prefix}{i}"
        for i in range(1, 6)
    )
    return f"""SELECT c.cont_id, {cols} FROM (SELECT DISTINCT cont_id FROM {src}) c LEFT JOIN (
  SELECT cont_id, prod_name, row_number() OVER (PARTITION BY cont_id ORDER BY {SERVING_ORDER}, place)
    AS position FROM placed) p USING (cont_id) GROUP BY c.cont_id"""


def ratios(hits, recommended, relevant):
    return f"""SELECT hits, n_recommended, n_relevant,
       CAST(hits AS DOUBLE) / nullif(n_relevant, 0) AS hits_per_relevant,
       CAST(hits AS DOUBLE) / nullif(n_recommended, 0) AS hits_per_recommended
FROM (SELECT CAST(({hits}) AS BIGINT) AS hits, CAST(({recommended}) AS BIGINT) AS n_recommended,
             CAST(({relevant}) AS BIGINT) AS n_relevant)"""


def sql(ctes, body):
    return "WITH " + ",\n".join(ctes) + "\n" + body


TARGET_ROWS = """target_rows AS (SELECT r.* FROM {src} r JOIN split USING (cont_id, transaction_id)
  WHERE part = 'target')"""
# Features of history describe customers with enough orders only; the others do not bound them.
TRAINING_ROWS = """history_rows AS (SELECT r.* FROM {src} r JOIN split USING (cont_id, transaction_id)
  WHERE part = 'history' AND n_orders >= {n})"""
HISTORY_ROWS = """history_rows AS (SELECT r.* FROM {src} r JOIN split USING (cont_id, transaction_id)
  WHERE part = 'history')"""

CATEGORISED = [RAW, CATS, """categorised AS (
  SELECT raw.*, coalesce(category1, 'X') AS category1, coalesce(category2, 'X') AS category2
  FROM raw LEFT JOIN cats USING (prod_family, prod_subfamily))"""]

INBOX_COLUMNS = ("cont_id, transaction_id, transaction_date, prod_id, model_id, prod_family, "
                 "prod_subfamily, prod_name, category1, category2, \"CAT1\"")


def _paged(src, group, value, order, size, name):
    return f"""SELECT {group}, page, string_agg({value}, '|' ORDER BY position) AS {name}
FROM (SELECT *, (position - 1) // {size} + 1 AS page FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS position FROM {src}))
GROUP BY {group}, page"""


ORACLE = {
    "scan_purchases_csv": sql([RAW], "SELECT * FROM raw"),
    "scan_categories_csv": sql([CATS], "SELECT * FROM cats"),
    "purchases_table_scan": sql(INBOX, f"SELECT {INBOX_COLUMNS} FROM inbox"),
    "menu_table_scan": sql(MENU, "SELECT * FROM menu"),
    "all_recos_csv": sql(
        ROWS + by_customers(n=8) + gated() + unrolled("prod_name", 1), wide("rows", "recommendation_")
    ),
    "dated_csv_export": sql(MENU, "SELECT *, '20240601 file.csv' AS file_name FROM menu"),
    "clean_exclude_text": sql([RAW], """SELECT * FROM raw
WHERE NOT contains(lower(prod_name), 'old') AND NOT contains(lower(prod_name), 'gizmo')"""),
    "clean_exclude_exact": sql([RAW], "SELECT * FROM raw WHERE prod_subfamily <> 'STANDARD'"),
    "drop_missing_rows": sql([RAW], "SELECT * FROM raw WHERE prod_subfamily <> 'STANDARD'"),
    "active_customers": sql([RAW, F5], "SELECT * FROM f5"),
    "supported_products": sql([RAW, F5, F7], "SELECT * FROM f7"),
    "recent_products": sql([RAW, F5, F7, F8], "SELECT * FROM f8"),
    "last_sale_dates": sql(
        [RAW], "SELECT prod_name, max(transaction_date) AS last_date FROM raw GROUP BY prod_name"
    ),
    "order_counts": sql([RAW], """SELECT prod_name, count(DISTINCT transaction_id) AS n_orders
FROM raw GROUP BY prod_name"""),
    "dedupe_rows": sql([RAW, F5, F7, F8, X2], "SELECT * FROM x2"),
    "categorize": sql(CATEGORISED, "SELECT * FROM categorised"),
    "drop_uncategorized": sql(CATEGORISED, "SELECT * FROM categorised WHERE category1 <> 'X'"),
    "category_labels": sql(
        CATEGORISED, f'SELECT DISTINCT prod_name, category1, {LABEL} AS "CAT1" FROM categorised'
    ),
    "model_ids": sql([RAW], """SELECT prod_family, prod_subfamily, prod_name,
       row_number() OVER (ORDER BY prod_family, prod_subfamily, prod_name) AS model_id
FROM (SELECT DISTINCT prod_family, prod_subfamily, prod_name FROM raw)"""),
    "first_hierarchy": sql([RAW], """SELECT prod_name, prod_family, prod_subfamily FROM raw
QUALIFY row_number() OVER (PARTITION BY prod_name
  ORDER BY transaction_date, transaction_id, prod_family, prod_subfamily) = 1"""),
    "ingest_purchases": sql(INBOX, f"SELECT {INBOX_COLUMNS} FROM inbox"),
    "ingest_menu": sql(MENU, "SELECT * FROM menu"),
    "upload_purchases": sql(INBOX, f"SELECT {INBOX_COLUMNS} FROM inbox"),
    "upload_menu": sql(MENU, "SELECT * FROM menu"),
    "menu_by_subfamily": sql(
        MENU + ["names AS (SELECT DISTINCT prod_subfamily, prod_name FROM menu)"],
        _paged("names", "prod_subfamily", "prod_name", "prod_name", 20, "prod_names"),
    ),
    "menu_by_family": sql(
        MENU + ['names AS (SELECT DISTINCT "CAT1", prod_family, prod_subfamily FROM menu)'],
        _paged("names", '"CAT1", prod_family', "prod_subfamily", "prod_subfamily", 1000, "prod_subfamilies"),
    ),
    "menu_head": sql(MENU, """SELECT f.*, n.prod_name, n.product_no FROM (
  SELECT *, row_number() OVER (PARTITION BY "CAT1", prod_family ORDER BY prod_subfamily) AS subfamily_no
  FROM (SELECT DISTINCT "CAT1", prod_family, prod_subfamily FROM menu) QUALIFY subfamily_no <= 3) f
JOIN (
  SELECT *, row_number() OVER (PARTITION BY prod_subfamily ORDER BY prod_name) AS product_no
  FROM (SELECT DISTINCT prod_subfamily, prod_name FROM menu) QUALIFY product_no <= 3) n
USING (prod_subfamily)"""),
    "customer_history": sql(FEEDBACK, """SELECT cont_id, transaction_date AS "ORDER DATE",
  prod_family AS "FAMILY", prod_subfamily AS "SUB-FAMILY", prod_name AS "MODEL", model_id AS "MODEL ID",
  transaction_id AS "ORDER #" FROM fed WHERE cont_id IN (SELECT client_id FROM requests)"""),
    "product_lookup": sql(FEEDBACK, """SELECT DISTINCT "CAT1", category1, prod_family, category2,
  prod_subfamily, prod_name, model_id FROM rows WHERE model_id IN (SELECT model_id FROM suggestions)"""),
    "purchase_counts": sql([RAW, counts("raw")], "SELECT * FROM counts"),
    "item_qty": sql([RAW], """SELECT *, count(*) OVER (PARTITION BY cont_id, prod_name) AS qty FROM raw"""),
    "item_weights": sql(
        [RAW],
        """SELECT cont_id, prod_name, CAST(sum(qty) AS DOUBLE) AS weight FROM (
  SELECT *, count(*) OVER (PARTITION BY cont_id, prod_name) AS qty FROM raw) GROUP BY 1, 2""",
    ),
    "column_min_max": sql(
        [RAW] + weights("raw"), "SELECT prod_name, CAST(low AS BIGINT) AS low, high FROM bounds"
    ),
    "minmax_features": sql([RAW] + weights("raw"), "SELECT * FROM weights"),
    "row_norms": sql([RAW] + weights("raw"), """SELECT cont_id,
  round(sqrt(sum(weight * weight)), 8) AS norm FROM weights GROUP BY cont_id"""),
    "seed_products": sql([RAW, counts("raw")], """SELECT cont_id, prod_name FROM counts
QUALIFY row_number() OVER (PARTITION BY cont_id ORDER BY cnt DESC, prod_name) = 1"""),
    "wide_counts": sql([RAW], "SELECT cont_id, " + ", ".join(
        f"count(*) FILTER (WHERE prod_family = 'Brand#{i}') AS \"Brand#{i}\"" for i in range(1, 26)
    ) + " FROM raw GROUP BY cont_id"),
    "order_split": sql([RAW] + orders("raw"), "SELECT * FROM split"),
    "order_split_by_date": sql(
        [RAW] + orders("raw", "order_date, transaction_id"), "SELECT * FROM split"
    ),
    "split_lists": sql(
        [RAW] + orders("raw")
        + ["r AS (SELECT cont_id, part, order_no, prod_name FROM raw JOIN split USING (cont_id, transaction_id))"],
        _paged("r", "cont_id, part", "prod_name", "order_no, prod_name", 50, "products"),
    ),
    "train_customers": sql([RAW], """SELECT cont_id FROM raw GROUP BY cont_id
HAVING count(DISTINCT transaction_id) >= 8"""),
    "test_customers": sql([RAW], """SELECT cont_id FROM raw GROUP BY cont_id
HAVING count(DISTINCT transaction_id) < 8"""),
    "set_sizes": sql([RAW], """SELECT count(*) AS n_all, count(*) FILTER (WHERE n >= 8) AS n_train,
  count(*) FILTER (WHERE n < 8) AS n_test
FROM (SELECT count(DISTINCT transaction_id) AS n FROM raw GROUP BY cont_id)"""),
    "random_customer": sql([RAW], """SELECT cont_id FROM (SELECT DISTINCT cont_id FROM raw)
ORDER BY md5('42:' || cont_id), cont_id LIMIT 1"""),
    "user_knn_neighbors": sql([RAW] + user_nn("raw"), "SELECT * FROM nn"),
    "item_knn_neighbors": sql([RAW] + item_nn("raw"), "SELECT * FROM inn"),
    "user_knn_by_family": sql(
        [RAW, "fam AS (SELECT cont_id, prod_family AS prod_name FROM raw)"] + user_nn("fam"),
        "SELECT * FROM nn",
    ),
    "user_knn_by_family_pivots": sql(
        [RAW, "fam AS (SELECT cont_id, prod_family AS prod_name FROM raw)"] + user_nn("fam"),
        "SELECT * FROM nn",
    ),
    "user_knn_joined": sql([RAW] + user_nn("raw"), "SELECT * FROM nn"),
    "euclid_knn_neighbors": sql(
        [RAW] + weights("raw") + [f"""norms AS (
  SELECT cont_id, {grid('sum(weight * weight)', 12)} AS sq FROM weights GROUP BY cont_id)""", """dots AS (
  SELECT a.cont_id AS q, b.cont_id AS n, sum(a.weight * b.weight) AS dot
  FROM weights a JOIN weights b USING (prod_name) WHERE a.weight > 0 AND b.weight > 0 GROUP BY 1, 2)"""],
        f"""SELECT cont_id, neighbor_id, dist,
  row_number() OVER (PARTITION BY cont_id ORDER BY dist, neighbor_id) AS neighbor_rank
FROM (SELECT a.cont_id, b.cont_id AS neighbor_id,
  {grid('sqrt(2.0 * ' + grid('greatest((a.sq + b.sq) / 2 - coalesce(dot, 0.0), 0.0)', 12) + ')')} AS dist
  FROM norms a CROSS JOIN norms b LEFT JOIN dots ON q = a.cont_id AND n = b.cont_id)
QUALIFY neighbor_rank <= 10"""),
    "user_knn_history_without_self": sql(
        [RAW] + orders("raw") + [HISTORY_ROWS.format(src="raw")] + weights("raw") + unit()
        + weights("history_rows", "_h") + unit("_h"),
        f"""SELECT cont_id, neighbor_id, dist,
  row_number() OVER (PARTITION BY cont_id ORDER BY dist, neighbor_id) AS neighbor_rank
FROM (SELECT a.cont_id, b.cont_id AS neighbor_id, {cosine_distance('sum(a.u * b.u)')} AS dist
      FROM unit a JOIN unit_h b USING (prod_name) WHERE a.cont_id <> b.cont_id
      GROUP BY a.cont_id, b.cont_id)
QUALIFY neighbor_rank <= 10"""),
    "vote_last": sql(ROWS + by_customers(vote="last", n=10), "SELECT * FROM picks"),
    "vote_sum": sql(ROWS + by_customers(vote="sum", n=10), "SELECT * FROM picks"),
    "target_counts": sql([RAW] + orders("raw") + targets("raw"), "SELECT * FROM targets"),
    "recommendation_products": sql(ROWS + by_customers() + gated(), "SELECT * FROM shown"),
    "recommend_user": sql(ROWS + by_customers() + gated(), served()),
    "recommend_user_unsorted": sql(
        ROWS + by_customers() + gated(), served("rank, prod_name, model_id")
    ),
    "recommend_user_with_feedback": sql(FEEDBACK + by_customers("fed") + gated("fed"), served()),
    "recommend_item_with_feedback": sql(
        FEEDBACK + by_products("fed", past="rows"), "SELECT * FROM picks"
    ),
    "eval_user_with_feedback": sql(
        FEEDBACK + by_customers("fed") + gated("fed") + unrolled('"CAT1"', 3),
        ratios(
            """SELECT count(*) FROM (SELECT DISTINCT cont_id, prod_name FROM placed
               INTERSECT SELECT DISTINCT cont_id, prod_name FROM fed)""",
            "SELECT count(*) FROM placed",
            "SELECT count(*) FROM (SELECT DISTINCT cont_id, prod_name FROM fed)",
        ),
    ),
    "eval_item_with_feedback": sql(
        FEEDBACK + by_products("fed", past="rows") + gated("fed") + unrolled('"CAT1"', 3)
        + [TARGET_ROWS.format(src="rows")],
        ratios(
            """SELECT count(*) FROM placed p WHERE EXISTS (SELECT 1 FROM target_rows t
               WHERE t.cont_id = p.cont_id AND t.prod_name = p.prod_name)""",
            "SELECT count(*) FROM placed",
            "SELECT count(*) FROM target_rows",
        ),
    ),
    "recommend_euclid": sql(
        ROWS + orders("rows") + [TRAINING_ROWS.format(src="rows", n=5)] + weights("rows")
        + weights("history_rows", "_h") + ["base AS (SELECT * FROM weights_h)",
        f"""qn AS (SELECT cont_id, {grid('sum(weight * weight)', 12)} AS sq FROM weights GROUP BY 1)""",
        f"""bn AS (SELECT cont_id, {grid('sum(weight * weight)', 12)} AS sq FROM base GROUP BY 1)""",
        """dots AS (SELECT a.cont_id AS q, b.cont_id AS n, sum(a.weight * b.weight) AS dot
  FROM weights a JOIN base b USING (prod_name) WHERE a.weight > 0 AND b.weight > 0 GROUP BY 1, 2)""",
        f"""nn AS (SELECT cont_id, neighbor_id, dist,
  row_number() OVER (PARTITION BY cont_id ORDER BY dist, neighbor_id) AS neighbor_rank
  FROM (SELECT a.cont_id, b.cont_id AS neighbor_id,
    {grid('sqrt(2.0 * ' + grid('greatest((a.sq + b.sq) / 2 - coalesce(dot, 0.0), 0.0)', 12) + ')')} AS dist
    FROM qn a CROSS JOIN bn b LEFT JOIN dots ON q = a.cont_id AND n = b.cont_id)
  QUALIFY neighbor_rank <= 10)"""] + targets("rows") + picks("sum", 10), "SELECT * FROM picks"),
    "recommend_item": sql(ROWS + by_products(), "SELECT * FROM picks"),
    "recommend_item_all_seeds": sql(
        ROWS + by_products(weight="cnt", seed="all", order="dist, prod_name"), "SELECT * FROM picks"
    ),
    "serve_item": sql(ROWS + by_products() + gated(), served()),
    "category_gate": sql(
        ROWS + by_customers(n=8) + gated(), 'SELECT cont_id, prod_name, category1, "CAT1", rank FROM gated'
    ),
    "top_per_category": sql(
        ROWS + by_customers() + gated() + unrolled('"CAT1"', 3),
        """SELECT cont_id, "CAT1", prod_name, rank, count(*) AS places FROM placed
GROUP BY cont_id, "CAT1", prod_name, rank, model_id""",
    ),
    "top_per_product": sql(
        ROWS + by_customers(n=8) + gated() + unrolled("prod_name", 1),
        f"""SELECT cont_id, prod_name,
  row_number() OVER (PARTITION BY cont_id ORDER BY {SERVING_ORDER}) AS position FROM placed""",
    ),
    "all_recos_wide": sql(
        ROWS + by_customers(n=8) + gated() + unrolled("prod_name", 1), wide("rows", "recommendation_")
    ),
    "all_recos_wide_item": sql(
        ROWS + by_products() + gated() + unrolled("prod_name", 5), wide("rows", "prod_name")
    ),
    "all_recos_item_csv": sql(
        ROWS + by_products() + gated() + unrolled("prod_name", 5), wide("rows", "prod_name")
    ),
    "eval_user": sql(
        ROWS + by_customers() + gated() + unrolled('"CAT1"', 3),
        ratios(
            """SELECT count(*) FROM (SELECT DISTINCT cont_id, prod_name FROM placed
               INTERSECT SELECT DISTINCT cont_id, prod_name FROM rows)""",
            "SELECT count(*) FROM placed",
            "SELECT count(*) FROM (SELECT DISTINCT cont_id, prod_name FROM rows)",
        ),
    ),
    "eval_item": sql(
        ROWS + by_products() + gated() + unrolled('"CAT1"', 3) + [TARGET_ROWS.format(src="rows")],
        ratios(
            """SELECT count(*) FROM placed p WHERE EXISTS (SELECT 1 FROM target_rows t
               WHERE t.cont_id = p.cont_id AND t.prod_name = p.prod_name)""",
            "SELECT count(*) FROM placed",
            "SELECT count(*) FROM target_rows",
        ),
    ),
    "hit_counts": sql(
        [RAW] + orders("raw") + [TARGET_ROWS.format(src="raw"), HISTORY_ROWS.format(src="raw")],
        ratios(
            """SELECT count(*) FROM history_rows h WHERE EXISTS (SELECT 1 FROM target_rows t
               WHERE t.cont_id = h.cont_id AND t.prod_name = h.prod_name)""",
            "SELECT count(*) FROM history_rows",
            "SELECT count(*) FROM target_rows",
        ),
    ),
    "recommend_user_stored": sql(ROWS + by_customers(), "SELECT * FROM picks"),
    "refit_delta": sql(FEEDBACK + item_nn("fed"), "SELECT * FROM inn"),
    "refit_affected": sql(
        FEEDBACK + item_nn("rows") + [
            """changed AS (SELECT DISTINCT prod_name FROM suggestions)""",
            """renewed AS (SELECT prod_name FROM changed UNION
  SELECT i.prod_name FROM inn i JOIN changed c ON i.neighbor_id = c.prod_name)""",
        ],
        "SELECT (SELECT count(*) FROM changed) AS n_changed, count(*) AS n_renewed FROM renewed",
    ),
    "recommend_item_refitted": sql(FEEDBACK + by_products("fed", past="rows"), "SELECT * FROM picks"),
    "feedback_rows": sql(FEEDBACK, "SELECT * FROM suggestions"),
    "feedback_rows_weighted": sql(FEEDBACK, "SELECT *, 1 AS qty FROM suggestions"),
    "feedback_unknown_names": sql(FEEDBACK, """SELECT client_id, form, pos, prod_name FROM requests
WHERE prod_name NOT IN (SELECT prod_name FROM lookup)"""),
    "purchases_with_feedback": sql(FEEDBACK, f"SELECT {INBOX_COLUMNS} FROM fed"),
    "reset_feedback": sql(ROWS, f"SELECT {INBOX_COLUMNS} FROM rows"),
    "without_feedback": sql(ROWS, f"SELECT {INBOX_COLUMNS} FROM rows"),
}
