"""Postings derived from the driver's order tables: one text that both SQL engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {orders} and {customer} stand for the tables, {text} for the engine's string type.
JOBS_SQL = """
WITH titles(i, title) AS (VALUES (0, 'Data Analyst'), (1, 'Senior Data Scientist'), (2, 'Machine Learning Engineer'), (3, 'Backend Engineer II'),
  (4, 'Recruiter'), (5, 'SDE-2'), (6, 'QA Automation Engineer'), (7, 'Product Manager'), (8, 'Associate Software Engineer'), (9, 'Graduate Backend Engineer'),
  (10, 'Technical Lead'), (11, 'Account Executive'), (12, 'Full Stack Developer'), (13, 'ML Engineer IC3'), (14, 'Graphic Designer'), (15, 'Leadership Coach'), (16, 'NLP Engineer')),
companies(i, company) AS (VALUES (0, 'Google'), (1, 'Alphabet'), (2, 'Facebook'), (3, 'Meta'), (4, 'Flipkart'), (5, 'Acme AI'), (6, 'Globex'), (7, 'Initech'), (8, 'AWS'), (9, 'Zomato'), (10, 'Grofers')),
locs(i, location) AS (VALUES (0, 'Bengaluru, India'), (1, 'Remote (WFH)'), (2, 'Hyderabad'), (3, 'Berlin'), (4, 'Austin, USA'), (5, 'Hybrid - Mumbai'), (6, NULL), (7, '')),
tools(i, tool) AS (VALUES (0, 'SQL'), (1, 'React, k8s'), (2, 'Google Cloud and Golang'), (3, 'torch'), (4, 'Postgres; mongo'), (5, 'reactive systems'), (6, 'leadership, Pytest'))
SELECT o.o_orderkey AS seq, CAST(o.o_orderkey AS {text}) AS external_id, t.title, c.company, l.location,
  CASE o.o_orderkey % 10 WHEN 0 THEN concat('Build RAG with Python, FastAPI, PyTorch. 0-', 1 + o.o_custkey % 4, ' years.')
    WHEN 1 THEN concat(2 + o.o_custkey % 9, '+ years Java, Spring, Kubernetes. $', 80 + o.o_custkey % 70, 'k - $', 130 + o.o_custkey % 90, 'k per year')
    WHEN 2 THEN concat(k.tool, ', Python, dashboards. Fresher. ', 10 + o.o_custkey % 20, '-', 25 + o.o_custkey % 30, ' LPA')
    WHEN 3 THEN concat('Minimum ', 1 + o.o_custkey % 7, ' years of experience. ', 1 + o.o_custkey % 3, '.', o.o_custkey % 10, ' crore CTC')
    WHEN 4 THEN 'We seek a seasoned, experienced professional. Full time' WHEN 5 THEN concat('Docker and AWS, strong communication. stipend ', 5000 + o.o_custkey % 400 * 100, ' per month, 6-month internship')
    WHEN 7 THEN concat(1 + o.o_custkey % 6, '+ years experience with ', k.tool, '. Contract to hire') WHEN 8 THEN concat('We work in the category of data processing. Pay €', 30 + o.o_custkey % 50, ',000 annually. ', k.tool)
    WHEN 9 THEN concat(10 + o.o_custkey % 90, '+ customers served; part-time, £', 20 + o.o_custkey % 30, ' per hour') END AS description,
  concat('https://www.Boards.Example/', lower(replace(c.company, ' ', '-')), '/jobs/', CAST(o.o_orderkey % 997 AS {text}), '/?utm=', CAST(o.o_custkey AS {text})) AS url,
  o.o_orderdate AS posted_date, u.c_mktsegment AS segment, o.o_custkey AS custkey, o.o_totalprice AS totalprice
FROM {orders} o JOIN {customer} u ON o.o_custkey = u.c_custkey
JOIN titles t ON o.o_orderkey % 17 = t.i JOIN companies c ON o.o_orderkey % 11 = c.i
JOIN locs l ON o.o_orderkey % 8 = l.i JOIN tools k ON o.o_custkey % 7 = k.i
"""

#: The head of an oracle query: jobs_v as a common table expression.
ORACLE_JOBS = "WITH jobs_v AS (" + JOBS_SQL.format(orders="orders", customer="customer", text="VARCHAR") + ")\n"

#: The fixed moment that stands for now in queries over the order tables.
NOW = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings: seq, external_id, title, company, location, description, url, posted_date and more."""
    sql = JOBS_SQL.replace("{text}", "STRING")
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))
