from basketry.sources.tables import (  # noqa: F401
    TABLES, clicks, day, epoch_micros, epoch_seconds, money, net_paid,
    sale_lines, scan_columnar, table,
)
