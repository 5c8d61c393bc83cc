"""Row types of the warehouse's layers, as DDL."""

from __future__ import annotations

DEC = "decimal(16,2)"
_ENVELOPE = "before map<string,string>, after map<string,string>, source struct<db:string,table:string,ts_ms:bigint>, op string, ts_ms bigint"

#: Debezium's JSON envelope; images are maps, as every table has its own columns.
CHANGE = _ENVELOPE
LOG = (
    "common struct<mid:string,is_new:string,vc:string,ch:string,ar:string>, page struct<page_id:string,last_page_id:string,during_time:bigint>, start string, displays array<map<string,string>>, ts bigint"
)
TABLE_PROCESS = ("source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string")
ORDER_INFO = (
    f"id bigint, province_id bigint, order_status string, user_id bigint, total_amount {DEC}, activity_reduce_amount {DEC}, coupon_reduce_amount {DEC}, original_total_amount {DEC}, feight_fee {DEC}, expire_time string, create_time string, operate_time string"
)
ORDER_DETAIL = (f"id bigint, order_id bigint, sku_id bigint, order_price {DEC}, sku_num bigint, sku_name string, create_time string, split_total_amount {DEC}, split_activity_amount {DEC}, split_coupon_amount {DEC}")
PAYMENT_INFO = (f"id bigint, order_id bigint, user_id bigint, total_amount {DEC}, subject string, payment_type string, create_time string, callback_time string")
ORDER_WIDE = (
    "order_id bigint, province_id bigint, order_status string, user_id bigint, total_amount decimal(16,2), activity_reduce_amount decimal(16,2), coupon_reduce_amount decimal(16,2), original_total_amount decimal(16,2), feight_fee decimal(16,2), create_time string, create_date string, create_hour string, detail_id bigint, sku_id bigint, order_price decimal(16,2), sku_num bigint, split_total_amount decimal(16,2), split_activity_amount decimal(16,2), split_coupon_amount decimal(16,2), split_feight_fee decimal(16,2), expire_time string, operate_time string, user_gender string, user_age int, province_name string, province_area_code string, province_iso_code string, province_3166_2_code string, sku_name string, category3_id string, spu_id string, tm_id string, spu_name string, tm_name string, category3_name string"
)
VISITOR_STATS = ("stt string, edt string, vc string, ch string, ar string, is_new string, uv_ct bigint, pv_ct bigint, sv_ct bigint, uj_ct bigint, dur_sum bigint, ts bigint")


def names(ddl: str) -> list[str]:
    """The column names of a DDL of simple types."""
    return [part.split()[0] for part in ddl.split(", ")]
