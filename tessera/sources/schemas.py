"""Foreign keys of public benchmark schemas, for graphs of other tables than the driver's."""

from __future__ import annotations

from tessera.sources.tables import FOREIGN_KEYS, ForeignKey

# The foreign keys that the schemas of TPC-H and TPC-DS declare.
TPCH = (
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("lineitem", "l_partkey", "partsupp", "ps_partkey"),
    ForeignKey("lineitem", "l_suppkey", "partsupp", "ps_suppkey"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("partsupp", "ps_partkey", "part", "p_partkey"),
    ForeignKey("partsupp", "ps_suppkey", "supplier", "s_suppkey"),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
)
TPCDS = (
    ForeignKey("catalog_returns", "cr_returned_date_sk", "date_dim", "d_date_sk"),
    ForeignKey("catalog_returns", "cr_returned_time_sk", "time_dim", "t_time_sk"),
    ForeignKey("catalog_returns", "cr_item_sk", "item", "i_item_sk"),
    ForeignKey("catalog_returns", "cr_item_sk", "catalog_sales", "cs_item_sk"),
    ForeignKey("catalog_returns", "cr_refunded_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("catalog_returns", "cr_refunded_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("catalog_returns", "cr_refunded_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("catalog_returns", "cr_refunded_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("catalog_returns", "cr_returning_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("catalog_returns", "cr_returning_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("catalog_returns", "cr_returning_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("catalog_returns", "cr_returning_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("catalog_returns", "cr_call_center_sk", "call_center", "cc_call_center_sk"),
    ForeignKey("catalog_returns", "cr_catalog_page_sk", "catalog_page", "cp_catalog_page_sk"),
    ForeignKey("catalog_returns", "cr_ship_mode_sk", "ship_mode", "sm_ship_mode_sk"),
    ForeignKey("catalog_returns", "cr_warehouse_sk", "warehouse", "w_warehouse_sk"),
    ForeignKey("catalog_returns", "cr_reason_sk", "reason", "r_reason_sk"),
    ForeignKey("catalog_returns", "cr_order_number", "catalog_sales", "cs_order_number"),
    ForeignKey("catalog_sales", "cs_sold_date_sk", "date_dim", "d_date_sk"),
    ForeignKey("catalog_sales", "cs_sold_time_sk", "time_dim", "t_time_sk"),
    ForeignKey("catalog_sales", "cs_ship_date_sk", "date_dim", "d_date_sk"),
    ForeignKey("catalog_sales", "cs_bill_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("catalog_sales", "cs_bill_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("catalog_sales", "cs_bill_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("catalog_sales", "cs_bill_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("catalog_sales", "cs_ship_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("catalog_sales", "cs_ship_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("catalog_sales", "cs_ship_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("catalog_sales", "cs_ship_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("catalog_sales", "cs_call_center_sk", "call_center", "cc_call_center_sk"),
    ForeignKey("catalog_sales", "cs_catalog_page_sk", "catalog_page", "cp_catalog_page_sk"),
    ForeignKey("catalog_sales", "cs_ship_mode_sk", "ship_mode", "sm_ship_mode_sk"),
    ForeignKey("catalog_sales", "cs_warehouse_sk", "warehouse", "w_warehouse_sk"),
    ForeignKey("catalog_sales", "cs_item_sk", "item", "i_item_sk"),
    ForeignKey("catalog_sales", "cs_promo_sk", "promotion", "p_promo_sk"),
    ForeignKey("inventory", "inv_date_sk", "date_dim", "d_date_sk"),
    ForeignKey("inventory", "inv_item_sk", "item", "i_item_sk"),
    ForeignKey("inventory", "inv_warehouse_sk", "warehouse", "w_warehouse_sk"),
    ForeignKey("store_returns", "sr_returned_date_sk", "date_dim", "d_date_sk"),
    ForeignKey("store_returns", "sr_return_time_sk", "time_dim", "t_time_sk"),
    ForeignKey("store_returns", "sr_item_sk", "item", "i_item_sk"),
    ForeignKey("store_returns", "sr_item_sk", "store_sales", "ss_item_sk"),
    ForeignKey("store_returns", "sr_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("store_returns", "sr_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("store_returns", "sr_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("store_returns", "sr_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("store_returns", "sr_store_sk", "store", "s_store_sk"),
    ForeignKey("store_returns", "sr_reason_sk", "reason", "r_reason_sk"),
    ForeignKey("store_returns", "sr_ticket_number", "store_sales", "ss_ticket_number"),
    ForeignKey("store_sales", "ss_sold_date_sk", "date_dim", "d_date_sk"),
    ForeignKey("store_sales", "ss_sold_time_sk", "time_dim", "t_time_sk"),
    ForeignKey("store_sales", "ss_item_sk", "item", "i_item_sk"),
    ForeignKey("store_sales", "ss_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("store_sales", "ss_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("store_sales", "ss_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("store_sales", "ss_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("store_sales", "ss_store_sk", "store", "s_store_sk"),
    ForeignKey("store_sales", "ss_promo_sk", "promotion", "p_promo_sk"),
    ForeignKey("web_returns", "wr_returned_date_sk", "date_dim", "d_date_sk"),
    ForeignKey("web_returns", "wr_returned_time_sk", "time_dim", "t_time_sk"),
    ForeignKey("web_returns", "wr_item_sk", "item", "i_item_sk"),
    ForeignKey("web_returns", "wr_item_sk", "web_sales", "ws_item_sk"),
    ForeignKey("web_returns", "wr_refunded_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("web_returns", "wr_refunded_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("web_returns", "wr_refunded_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("web_returns", "wr_refunded_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("web_returns", "wr_returning_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("web_returns", "wr_returning_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("web_returns", "wr_returning_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("web_returns", "wr_returning_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("web_returns", "wr_web_page_sk", "web_page", "wp_web_page_sk"),
    ForeignKey("web_returns", "wr_reason_sk", "reason", "r_reason_sk"),
    ForeignKey("web_returns", "wr_order_number", "web_sales", "ws_order_number"),
    ForeignKey("web_sales", "ws_sold_date_sk", "date_dim", "d_date_sk"),
    ForeignKey("web_sales", "ws_sold_time_sk", "time_dim", "t_time_sk"),
    ForeignKey("web_sales", "ws_ship_date_sk", "date_dim", "d_date_sk"),
    ForeignKey("web_sales", "ws_item_sk", "item", "i_item_sk"),
    ForeignKey("web_sales", "ws_bill_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("web_sales", "ws_bill_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("web_sales", "ws_bill_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("web_sales", "ws_bill_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("web_sales", "ws_ship_customer_sk", "customer", "c_customer_sk"),
    ForeignKey("web_sales", "ws_ship_cdemo_sk", "customer_demographics", "cd_demo_sk"),
    ForeignKey("web_sales", "ws_ship_hdemo_sk", "household_demographics", "hd_demo_sk"),
    ForeignKey("web_sales", "ws_ship_addr_sk", "customer_address", "ca_address_sk"),
    ForeignKey("web_sales", "ws_web_page_sk", "web_page", "wp_web_page_sk"),
    ForeignKey("web_sales", "ws_web_site_sk", "web_site", "web_site_sk"),
    ForeignKey("web_sales", "ws_ship_mode_sk", "ship_mode", "sm_ship_mode_sk"),
    ForeignKey("web_sales", "ws_warehouse_sk", "warehouse", "w_warehouse_sk"),
    ForeignKey("web_sales", "ws_promo_sk", "promotion", "p_promo_sk"),
)
# Edges of the Join Order Benchmark's tables as workloads walk them. They are no declared keys: joins start from title, so
# the references to it are turned round, and names are reached through aka_name.
JOB = (
    ForeignKey("aka_name", "person_id", "name", "id"),
    ForeignKey("cast_info", "person_id", "aka_name", "person_id"),
    ForeignKey("cast_info", "person_role_id", "char_name", "id"),
    ForeignKey("cast_info", "role_id", "role_type", "id"),
    ForeignKey("complete_cast", "subject_id", "comp_cast_type", "id"),
    ForeignKey("complete_cast", "status_id", "comp_cast_type", "id"),
    ForeignKey("movie_companies", "company_id", "company_name", "id"),
    ForeignKey("movie_companies", "company_type_id", "company_type", "id"),
    ForeignKey("movie_info", "info_type_id", "info_type", "id"),
    ForeignKey("movie_info_idx", "info_type_id", "info_type", "id"),
    ForeignKey("movie_keyword", "keyword_id", "keyword", "id"),
    ForeignKey("movie_link", "link_type_id", "link_type", "id"),
    ForeignKey("title", "id", "complete_cast", "movie_id"),
    ForeignKey("title", "id", "aka_title", "movie_id"),
    ForeignKey("title", "id", "movie_link", "movie_id"),
    ForeignKey("title", "id", "movie_link", "linked_movie_id"),
    ForeignKey("title", "id", "cast_info", "movie_id"),
    ForeignKey("title", "kind_id", "kind_type", "id"),
    ForeignKey("title", "id", "movie_info", "movie_id"),
    ForeignKey("title", "id", "movie_info_idx", "movie_id"),
    ForeignKey("title", "id", "movie_keyword", "movie_id"),
    ForeignKey("title", "id", "movie_companies", "movie_id"),
)
#: Tables that joins start from.
FACTS = {
    "tpch": ("lineitem", "orders", "partsupp"),
    "tpcds": ("catalog_returns", "catalog_sales", "inventory", "store_returns", "store_sales", "web_returns", "web_sales"),
    "job": ("title",),
    "driver": ("lineitem", "orders", "events", "labels"),
}


def keys_of(schema: str) -> tuple[ForeignKey, ...]:
    """The edges of a schema's join graph: tpch, tpcds, job, or the driver's own tables."""
    return {"tpch": TPCH, "tpcds": TPCDS, "job": JOB, "driver": FOREIGN_KEYS}[schema]
