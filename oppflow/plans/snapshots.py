"""Queries over the weekly exports."""

from __future__ import annotations

from ..operators.snapshots import snapshot_changes
from ..sources.tables import read_table


def p5_found(spark, sf_dir):
    return snapshot_changes(read_table(spark, sf_dir, "raw_opportunity_snapshots"))


QUERIES = {"p5_found": p5_found}
SQL = {
    "p5_found": """
with last as (
  select snapshot_no, regexp_replace(source_id, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g') source_id, upper(regexp_replace(source_reference, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g')) source_reference,
         lower(regexp_replace(content_hash, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g')) content_hash, lower(regexp_replace(source_status, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g')) source_status
  from raw_opportunity_snapshots
  qualify row_number() over (partition by snapshot_no, regexp_replace(source_id, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g'), upper(regexp_replace(source_reference, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g')) order by delivered_at desc,
                             lower(regexp_replace(content_hash, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g')) desc nulls last, lower(regexp_replace(source_status, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g')) desc nulls last) = 1
), numbers as (
  select snapshot_no, lag(snapshot_no) over (order by snapshot_no) before from (select distinct snapshot_no from last)
), new as (select l.* from last l join numbers n using (snapshot_no) where before is not null),
old as (select n.snapshot_no, source_id, source_reference, content_hash, source_status from last l join numbers n on l.snapshot_no = n.before)
select coalesce(a.snapshot_no, b.snapshot_no) snapshot_no, coalesce(a.source_id, b.source_id) source_id,
       coalesce(a.source_reference, b.source_reference) source_reference,
       case when b.snapshot_no is null then 'added' when a.snapshot_no is null then 'removed' else 'changed' end change_kind
from new a full join old b on a.snapshot_no = b.snapshot_no and a.source_id is not distinct from b.source_id
     and a.source_reference is not distinct from b.source_reference
where a.snapshot_no is null or b.snapshot_no is null or a.content_hash is distinct from b.content_hash
      or a.source_status is distinct from b.source_status
"""
}
