"""Column names and types of the star schema. Nothing is inferred from data.

``REVIEWS.review_date`` and the 1-5 rating scale are assumptions; see README, "Assumptions".
"""

from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MONEY = DecimalType(18, 2)


def _struct(**columns):
    return StructType([StructField(name, dtype, True) for name, dtype in columns.items()])


ORDERS = _struct(
    order_id=LongType(),
    customer_id=LongType(),
    order_date=DateType(),
    total_amount=MONEY,
)

ORDER_DETAILS = _struct(
    order_id=LongType(),
    book_id=LongType(),
    quantity=IntegerType(),
    discount=IntegerType(),
)

BOOKS = _struct(
    book_id=LongType(),
    title=StringType(),
    genre_id=LongType(),
    publisher_id=LongType(),
)

GENRE = _struct(genre_id=LongType(), genre_title=StringType())

PUBLISHER = _struct(publisher_id=LongType(), publisher_name=StringType())

CUSTOMER = _struct(
    customer_id=LongType(),
    first_name=StringType(),
    last_name=StringType(),
    gender=StringType(),
    preferred_language=StringType(),
)

REVIEWS = _struct(
    review_id=LongType(),
    book_id=LongType(),
    customer_id=LongType(),
    rating=IntegerType(),
    review_date=DateType(),
)

TABLES = {
    "orders": ORDERS,
    "order_details": ORDER_DETAILS,
    "books": BOOKS,
    "genre": GENRE,
    "publisher": PUBLISHER,
    "customer": CUSTOMER,
    "reviews": REVIEWS,
}

# Columns a source may lack; the demographic breakdown that needs one is then left out.
OPTIONAL_COLUMNS = {"customer": ("gender", "preferred_language")}

# Dimension files, after renaming (sources/csv_files.py).
GENRE_SIZES = _struct(genre_title=StringType(), n_sub_genres=IntegerType())
SUB_GENRES = _struct(sub_genre_title=StringType(), genre_title=StringType())
STATES = _struct(
    state=StringType(),
    state_code=StringType(),
    region=StringType(),
    division=StringType(),
    region_code=StringType(),
)

# Year of the order date: the folders of stored sales lines.
SALES_YEAR = "order_year"
