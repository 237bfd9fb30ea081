"""Table schemas (DDL strings) of the search corpus and the control tables."""

from __future__ import annotations

# The three stores a database may live in.
REGIONS = ("us-east", "us-west", "eu")

STARTER_CREDITS = 25
KEYS_PER_OWNER = 10
MAX_IMAGE_CHARS = 14 * 1024 * 1024
EMBEDDING_DIM = 1024


VECTORS = (
    "id BIGINT, tenant STRING, vector_id STRING, embedding ARRAY<FLOAT>, content STRING, "
    "metadata STRING, tokens ARRAY<STRING>, norm DOUBLE, created_at TIMESTAMP_NTZ, region STRING"
)
USERS = (
    "id INT, email STRING, name STRING, company STRING, credits INT, created_at TIMESTAMP_NTZ"
)
DATABASES = (
    "name STRING, db_type STRING, region STRING, requests INT, owner_id INT, "
    "created_at TIMESTAMP_NTZ"
)
API_KEYS = ("key STRING, name STRING, owner_id INT, created_at TIMESTAMP_NTZ")
TRANSACTIONS = (
    "user_id INT, user_email STRING, transaction_id STRING, customer_id STRING, price_id STRING, "
    "plan_name STRING, plan_description STRING, credits_purchased INT, amount_paid INT, "
    "status STRING, billed_at TIMESTAMP_NTZ, invoice_id STRING, invoice_number STRING, "
    "payment_method STRING"
)
USAGE_LOGS = ("user_id INT, usage_date DATE, credits_used BIGINT")
EMAIL_CODES = ("email STRING, code SMALLINT, expiry TIMESTAMP_NTZ")

QUERIES = (
    "query_id BIGINT, tenant STRING, text STRING, vector ARRAY<FLOAT>, filter STRING, "
    "page INT, limit INT"
)

PAYMENT_EVENT = (
    "event_type STRING, data STRUCT<id: STRING, customer_id: STRING, status: STRING, "
    "billed_at: STRING, invoice_id: STRING, invoice_number: STRING, "
    "custom_data: STRUCT<user_email: STRING, user_id: BIGINT>, "
    "items: ARRAY<STRUCT<price: STRUCT<id: STRING, name: STRING, description: STRING, "
    "custom_data: STRUCT<credits: STRING>, unit_price: STRUCT<amount: STRING>>>>, "
    "payments: ARRAY<STRUCT<method_details: STRUCT<type: STRING>>>>"
)
