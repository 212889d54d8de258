"""Fixed values of the scoring rules, and the schemas of what is read."""

# Fixed values -----------------------------------------------------------------
SCALE = 10000
DIMS = 14
NEIGHBOURS = 5
LEAF_SIZE = 128
LEAF_LIMITS = (32, 2048)
#: Squared distance at which an approximate search may stop: (0.14 * SCALE)^2.
EARLY_STOP = 1_960_000
MAX_AMOUNT, MAX_INSTALLMENTS, RATIO, MAX_MINUTES, MAX_KM, MAX_TX_24H, MAX_MERCHANT_AVG = 10000, 12, 10, 1440, 1000, 20, 10000
U32_MAX = 4294967295
MCC_SLOTS = 1024
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
# ------------------------------------------------------------------------------

VECTOR = tuple(f"v{i}" for i in range(DIMS))

REFERENCE_SCHEMA = "vector ARRAY<FLOAT>, label STRING"
NORMALIZATION_SCHEMA = "max_amount DOUBLE, max_installments DOUBLE, amount_vs_avg_ratio DOUBLE, max_minutes DOUBLE, max_km DOUBLE, max_tx_count_24h DOUBLE, max_merchant_avg_amount DOUBLE"
PAYLOAD_SCHEMA = (
    "id STRING, transaction STRUCT<amount: FLOAT, installments: BIGINT, requested_at: STRING>, "
    "customer STRUCT<avg_amount: FLOAT, tx_count_24h: BIGINT, known_merchants: ARRAY<STRING>>, "
    "merchant STRUCT<id: STRING, mcc: STRING, avg_amount: FLOAT>, "
    "terminal STRUCT<is_online: BOOLEAN, card_present: BOOLEAN, km_from_home: FLOAT>, "
    "last_transaction STRUCT<timestamp: STRING, km_from_current: FLOAT>"
)
