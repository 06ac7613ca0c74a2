"""SQL for DuckDB that answers each registered query over the raw synthetic tables.

Written apart from the operators and in the plainest form, with windows, self-joins and subqueries
where the operators use something faster, so that the two check each other.
"""

from __future__ import annotations

# The star schema over the raw tables; the same mapping as sources/synthetic.py.
STAR = {
    "t_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CAST(o_orderdate AS DATE) AS order_date,
               CAST(o_totalprice AS DECIMAL(18, 2)) AS total_amount
        FROM orders""",
    "t_details": """
        SELECT l_orderkey AS order_id, l_partkey AS book_id, CAST(l_quantity AS INTEGER) AS quantity
        FROM lineitem""",
    "t_books": """
        SELECT p_partkey AS book_id, p_name AS title,
               CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT) AS genre_id,
               CAST('0x' || substr(md5(p_brand), 1, 15) AS BIGINT) AS publisher_id
        FROM part""",
    "t_genre": """
        SELECT DISTINCT CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT) AS genre_id,
               p_type AS genre_title
        FROM part""",
    "t_publisher": """
        SELECT DISTINCT CAST('0x' || substr(md5(p_brand), 1, 15) AS BIGINT) AS publisher_id,
               p_brand AS publisher_name
        FROM part""",
    "t_customer": """
        SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name,
               split_part(c_name, '#', 2) AS last_name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Male' WHEN 'HOUSEHOLD' THEN 'Female'
                    ELSE c_mktsegment END AS gender,
               n_name AS preferred_language, c_acctbal
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "t_reviews": """
        SELECT event_id AS review_id, CAST(props::JSON ->> 'k' AS BIGINT) AS book_id,
               user_id AS customer_id,
               CASE WHEN value >= 150 THEN 1 WHEN value >= 90 THEN 2 WHEN value >= 50 THEN 3
                    WHEN value >= 20 THEN 4 ELSE 5 END AS rating,
               CAST(ts AS DATE) + CAST(400 * (event_id % 3) AS INTEGER) AS review_date
        FROM events""",
}

# The derived relations over the star, in the order they need each other.
VIEWS = {
    "v_purchases": """
        SELECT o.customer_id, d.book_id, b.title, g.genre_title
        FROM t_orders o
        JOIN t_details d ON d.order_id = o.order_id
        JOIN t_books b ON b.book_id = d.book_id
        JOIN t_genre g ON g.genre_id = b.genre_id""",
    "v_genre_counts": """
        SELECT customer_id, genre_title, COUNT(*) AS genre_count
        FROM v_purchases GROUP BY customer_id, genre_title""",
    "v_frequent": """
        SELECT c.customer_id, c.genre_title, c.genre_count
        FROM v_genre_counts c
        WHERE c.genre_count = (SELECT MAX(x.genre_count) FROM v_genre_counts x
                               WHERE x.customer_id = c.customer_id)""",
    "v_favourite": """
        SELECT customer_id, MIN(genre_title) AS genre_title FROM v_frequent GROUP BY customer_id""",
    "v_totals": """
        SELECT d.book_id, b.genre_id, b.title, CAST(SUM(d.quantity) AS BIGINT) AS total_book_sales
        FROM t_details d JOIN t_books b ON b.book_id = d.book_id
        GROUP BY d.book_id, b.genre_id, b.title""",
    "v_best": """
        SELECT genre_id, genre_title, title, book_id, total_book_sales
        FROM (SELECT t.*, RANK() OVER (PARTITION BY genre_id ORDER BY total_book_sales DESC) AS r
              FROM v_totals t) ranked
        JOIN t_genre USING (genre_id)
        WHERE r = 1""",
    "v_sentiment": """
        SELECT review_id, book_id, customer_id, rating, review_date,
               CASE WHEN rating <= 2 THEN 'Negative' WHEN rating = 3 THEN 'Neutral'
                    ELSE 'Positive' END AS review_classification
        FROM t_reviews WHERE rating IS NOT NULL""",
    "v_reviewed": """
        SELECT b.book_id, b.title, COUNT(*) AS total_reviews, AVG(r.rating) AS avg_rating,
               CASE WHEN AVG(r.rating) < 2.5 THEN 'Negative' WHEN AVG(r.rating) < 3.5 THEN 'Neutral'
                    ELSE 'Positive' END AS review_classification
        FROM t_reviews r JOIN t_books b ON b.book_id = r.book_id
        GROUP BY b.book_id, b.title""",
    "v_year_sales": """
        SELECT b.book_id, b.title, b.genre_id, CAST(SUM(d.quantity) AS BIGINT) AS sold
        FROM t_details d
        JOIN t_books b ON b.book_id = d.book_id
        JOIN t_orders o ON o.order_id = d.order_id
        WHERE YEAR(o.order_date) = 1998
        GROUP BY b.book_id, b.title, b.genre_id""",
    "v_monthly": """
        SELECT d.book_id, strftime(o.order_date, '%Y-%m-01') AS month,
               CAST(SUM(d.quantity) AS BIGINT) AS monthly_sales
        FROM t_details d JOIN t_orders o ON o.order_id = d.order_id
        GROUP BY ALL""",
}

GENRE_SENTIMENT = """
    SELECT g.genre_title, s.review_classification, COUNT(*) AS review_count
    FROM v_sentiment s
    JOIN t_books b ON b.book_id = s.book_id
    JOIN t_genre g ON g.genre_id = b.genre_id
    GROUP BY g.genre_title, s.review_classification"""

AVERAGE_VALUE = """
    SELECT c.customer_id, c.first_name, c.last_name,
           CAST(SUM(o.total_amount) AS DOUBLE) / COUNT(o.total_amount) AS avg_order_value
    FROM t_orders o JOIN t_customer c ON c.customer_id = o.customer_id
    GROUP BY c.customer_id, c.first_name, c.last_name"""

BODIES = {
    "customer_book_details": "SELECT * FROM v_purchases",
    "customer_frequent_genre": "SELECT * FROM v_frequent",
    "best_sellers_by_genre": "SELECT * FROM v_best",
    "customer_avg_value": AVERAGE_VALUE,
    "customer_total_orders": """
        SELECT customer_id, COUNT(*) AS total_orders FROM t_orders GROUP BY customer_id""",
    "review_sentiment": "SELECT * FROM v_sentiment",
    "reviews_per_book": "SELECT * FROM v_reviewed",
    "preferred_genre": "SELECT * FROM v_favourite",
    "purchased_in_preferred_genre": """
        SELECT p.customer_id, p.book_id, p.title, p.genre_title
        FROM v_purchases p
        JOIN v_favourite f ON f.customer_id = p.customer_id AND f.genre_title = p.genre_title""",
    "preferred_genre_best_sellers": """
        SELECT f.customer_id, f.genre_title, b.title, b.book_id
        FROM v_favourite f JOIN v_best b ON b.genre_title = f.genre_title""",
    "recommend_books": """
        SELECT f.customer_id, f.genre_title, b.title, b.book_id, b.total_book_sales
        FROM v_favourite f JOIN v_best b ON b.genre_title = f.genre_title
        WHERE NOT EXISTS (SELECT 1 FROM v_purchases p
                          WHERE p.customer_id = f.customer_id AND p.book_id = b.book_id)""",
    "purchased_in_preferred_genre_of_one": """
        SELECT p.customer_id, p.book_id, p.title, p.genre_title
        FROM v_purchases p JOIN v_favourite f USING (customer_id, genre_title)
        WHERE p.customer_id = 7""",
    "recommend_books_of_one": """
        SELECT f.customer_id, f.genre_title, b.title, b.book_id, b.total_book_sales
        FROM v_favourite f JOIN v_best b ON b.genre_title = f.genre_title
        WHERE f.customer_id = 7
          AND b.book_id NOT IN (SELECT book_id FROM v_purchases WHERE customer_id = 7)
        ORDER BY b.total_book_sales DESC, b.title, b.book_id""",
    "churn_risk": """
        SELECT customer_id, MAX(order_date) AS last_order_date,
               CAST(DATE '2001-08-01' - MAX(order_date) AS INTEGER) AS days_since_order
        FROM t_orders GROUP BY customer_id
        HAVING DATE '2001-08-01' - MAX(order_date) > 90""",
    "recency": """
        SELECT customer_id, MAX(order_date) AS last_order_date,
               CAST(DATE '2001-08-01' - MAX(order_date) AS INTEGER) AS days_since_order
        FROM t_orders GROUP BY customer_id""",
    "monetary": """
        SELECT c.customer_id, c.first_name, c.last_name,
               CAST(ROUND(SUM(o.total_amount), 2) AS DOUBLE) AS total_spend
        FROM t_orders o JOIN t_customer c ON c.customer_id = o.customer_id
        GROUP BY c.customer_id, c.first_name, c.last_name""",
    "monetary_of_one": """
        SELECT c.customer_id, c.first_name, c.last_name,
               CAST(ROUND(SUM(o.total_amount), 2) AS DOUBLE) AS total_spend
        FROM t_orders o JOIN t_customer c ON c.customer_id = o.customer_id
        WHERE c.customer_id = 7
        GROUP BY c.customer_id, c.first_name, c.last_name""",
    "average_order_value": AVERAGE_VALUE,
    "customer_lifetime_value": f"""
        SELECT a.customer_id, a.first_name, a.last_name,
               ROUND(a.avg_order_value * n.total_orders, 2) AS life_time_value
        FROM ({AVERAGE_VALUE}) a
        LEFT JOIN (SELECT customer_id, COUNT(*) AS total_orders FROM t_orders
                   GROUP BY customer_id) n ON n.customer_id = a.customer_id""",
    "avg_days_between_purchases": """
        SELECT customer_id,
               ROUND(AVG(order_date - previous_order_date), 2) AS avg_days_between_purchases
        FROM (SELECT customer_id, order_date,
                     LAG(order_date) OVER (PARTITION BY customer_id ORDER BY order_date)
                         AS previous_order_date
              FROM t_orders) gaps
        WHERE previous_order_date IS NOT NULL
        GROUP BY customer_id""",
    "tenure": """
        SELECT customer_id, MIN(order_date) AS first_order_date,
               MAX(order_date) AS latest_order_date,
               CAST(MAX(order_date) - MIN(order_date) AS INTEGER) AS tenure
        FROM t_orders GROUP BY customer_id""",
    "sentiment_by_year": """
        SELECT review_classification, COUNT(*) AS total_reviews
        FROM v_sentiment WHERE YEAR(review_date) = 2024 GROUP BY review_classification""",
    "top_reviewers": """
        SELECT c.customer_id, c.first_name, c.last_name, COUNT(*) AS number_of_reviews_given
        FROM t_reviews r JOIN t_customer c ON c.customer_id = r.customer_id
        GROUP BY c.customer_id, c.first_name, c.last_name
        ORDER BY number_of_reviews_given DESC, c.customer_id""",
    "top_reviewed_books": """
        SELECT book_id, title, review_classification FROM v_reviewed
        ORDER BY total_reviews DESC, book_id LIMIT 10""",
    "genre_sentiment_best": GENRE_SENTIMENT
    + " ORDER BY s.review_classification DESC, review_count DESC, g.genre_title",
    "genre_sentiment_worst": GENRE_SENTIMENT
    + " ORDER BY s.review_classification ASC, review_count DESC, g.genre_title",
    "customer_scan": "SELECT * FROM t_customer",
    "gender_distribution": """
        SELECT CASE WHEN gender IN ('Male', 'Female') THEN gender ELSE 'Others' END
                   AS gender_grouped,
               COUNT(*) AS customers,
               COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM t_customer) AS percent
        FROM t_customer GROUP BY 1""",
    "language_share": """
        SELECT preferred_language, COUNT(*) AS customers,
               COUNT(*) * 100.0::DOUBLE
                   / (SELECT COUNT(preferred_language) FROM t_customer) AS percent
        FROM t_customer WHERE preferred_language IS NOT NULL GROUP BY preferred_language""",
    "genre_sales_by_year": """
        SELECT g.genre_id, g.genre_title, CAST(SUM(s.sold) AS BIGINT) AS total_books_sold
        FROM v_year_sales s JOIN t_genre g ON g.genre_id = s.genre_id
        GROUP BY g.genre_id, g.genre_title
        ORDER BY total_books_sold DESC, g.genre_id""",
    "book_sales_by_year": """
        SELECT book_id, title, sold AS total_book_sales FROM v_year_sales
        ORDER BY sold DESC, book_id""",
    "top_bottom_books": """
        SELECT book_id, title,
               CASE WHEN length(title) > 35 THEN substr(title, 1, 35) || '…' ELSE title END
                   AS title_short,
               sold AS total_book_sales
        FROM (SELECT s.*, ROW_NUMBER() OVER (ORDER BY sold DESC, book_id) AS place,
                     COUNT(*) OVER () AS n
              FROM v_year_sales s) placed
        WHERE n < 20 OR place <= 10 OR place > n - 10
        ORDER BY sold DESC, book_id""",
    "poorly_performing_books": """
        SELECT b.book_id, b.title, COUNT(r.review_id) AS total_reviews,
               AVG(r.rating) AS avg_rating,
               CAST(SUM(CASE WHEN r.rating <= 2 THEN 1 ELSE 0 END) AS BIGINT)
                   AS negative_review_count
        FROM t_books b LEFT JOIN t_reviews r ON r.book_id = b.book_id
        GROUP BY b.book_id, b.title
        HAVING AVG(r.rating) < 3 OR SUM(CASE WHEN r.rating <= 2 THEN 1 ELSE 0 END) > 3""",
    "poorly_performing_books_strict": """
        SELECT b.book_id, b.title, COUNT(r.review_id) AS total_reviews,
               AVG(r.rating) AS avg_rating,
               CAST(SUM(CASE WHEN r.rating <= 2 THEN 1 ELSE 0 END) AS BIGINT)
                   AS negative_review_count
        FROM t_books b LEFT JOIN t_reviews r ON r.book_id = b.book_id
        GROUP BY b.book_id, b.title
        HAVING AVG(r.rating) < 3.6 OR SUM(CASE WHEN r.rating <= 2 THEN 1 ELSE 0 END) > 20""",
    "declining_sales": """
        SELECT b.book_id, b.title, c.month, c.monthly_sales, c.prev_month_sales, c.sales_change
        FROM (SELECT t.*, ROUND((CAST(monthly_sales - prev_month_sales AS DOUBLE)
                                 / NULLIF(prev_month_sales, 0)) * 100, 2) AS sales_change
              FROM (SELECT m.*, LAG(monthly_sales) OVER (PARTITION BY book_id ORDER BY month)
                               AS prev_month_sales
                    FROM v_monthly m) t) c
        JOIN t_books b ON b.book_id = c.book_id
        WHERE c.sales_change < -10
        ORDER BY c.sales_change, b.book_id, c.month
        LIMIT 10""",
    "publisher_revenue": """
        SELECT p.publisher_name, CAST(SUM(o.total_amount) AS DOUBLE) AS publisher_revenue
        FROM t_publisher p
        JOIN t_books b ON b.publisher_id = p.publisher_id
        JOIN t_details d ON d.book_id = b.book_id
        JOIN t_orders o ON o.order_id = d.order_id
        GROUP BY p.publisher_name
        ORDER BY publisher_revenue DESC, p.publisher_name""",
    "sub_genre_counts": """
        SELECT g.genre_title, COUNT(s.p_name) AS n_sub_genres
        FROM t_genre g
        LEFT JOIN (SELECT DISTINCT p_name, p_type FROM part) s ON s.p_type = g.genre_title
        GROUP BY g.genre_title""",
    "region_rollup": """
        SELECT r_name AS region, n_name AS division, COUNT(DISTINCT c_mktsegment) AS n_states
        FROM customer
        JOIN nation ON n_nationkey = c_nationkey
        JOIN region ON r_regionkey = n_regionkey
        GROUP BY r_name, n_name""",
}


def oracle_sql() -> dict[str, str]:
    """One statement per query; DuckDB leaves out the common table expressions it does not need."""
    relations = ",".join(f"\n{name} AS ({sql})" for name, sql in (STAR | VIEWS).items())
    return {name: f"WITH{relations}\n{body}" for name, body in BODIES.items()}
