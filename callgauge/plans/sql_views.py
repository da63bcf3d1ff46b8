"""The derived tables as SQL, for the checking statements: each statement inlines the ones it names."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "logs": """
select event_id, concat('evt-', cast(event_id as varchar(20))) as request_id, user_id as conversation_id,
 case user_id % 4 when 0 then 'anthropic' when 1 then 'openai' when 2 then 'gemini' else 'mock' end as provider,
 case when event_id % 2 = 0 then 'large' else 'small' end as model,
 event_type <> 'view' as streaming,
 case event_type when 'error' then 'error' when 'signup' then 'cancelled' else 'success' end as status,
 case when event_type = 'error' then case event_id % 3 when 0 then 'rate_limit' when 1 then 'provider_5xx' else 'provider_4xx' end end as error_type,
 cast(floor(value*10) as int) as latency_ms,
 case when event_type in ('click','purchase','signup') then cast(floor(value*3) as int) end as ttft_ms,
 case when event_type in ('click','purchase','view') then cast(floor(value*7) as int) end as total_tokens,
 event_id % 11 = 0 as pii_redacted,
 concat(event_type, ' ', props) as input_preview,
 case when event_type <> 'error' then concat('value ', cast(cast(floor(value) as int) as varchar(20))) end as output_preview,
 ts as requested_at, ts + (event_id % 5) * interval '1' second as ingested_at,
 cast(ts as date) as requested_date, props as metadata
from events""",
    "delivered": """
select event_id * 10 as stream_seq, * from logs
union all select event_id * 10 + 7 as stream_seq, * from logs where event_id % 9 = 0""",
    "messages": """
select conv_id as conversation_id, turn, role, text as content,
 timestamp '2024-01-01 00:00:00' + (conv_id * 100 + turn) * interval '1' second as created_at
from conversations""",
    "conversation_events": """
select conv_id, seq, kind, title, provider, timestamp '2024-01-01 00:00:00' + (conv_id * 3600 + seq) * interval '1' second as event_at from (
 select conv_id, 0 as seq, 'create' as kind, cast(null as varchar(60)) as title, cast(null as varchar(20)) as provider from conversations where turn = 0
 union all select conv_id, turn*10+1, 'message', null, null from conversations
 union all select conv_id, min(turn)*10+2, 'meta', substring(min_by(text, turn),1,60), null from conversations where role='user' group by conv_id
 union all select conv_id, turn*10+3, 'meta', null, case (conv_id+turn) % 3 when 0 then 'openai' when 1 then 'anthropic' else 'mock' end from conversations where role='user'
 union all select conv_id, 1000, 'cancel', null, null from conversations where turn = 0 and conv_id % 7 = 0
) z""",
    "state": """
select conv_id, max_by(title,seq) filter (where title is not null) as title, max_by(provider,seq) filter (where provider is not null) as provider,
 case when max(case when kind='cancel' then 1 else 0 end) = 1 then 'cancelled' else 'active' end as status,
 min(event_at) as created_at, max(event_at) as updated_at
from conversation_events group by conv_id""",
    "calls": """
select concat('call-', cast(k as varchar(20))) as request_id, k as call_id, conv_id, turn, text as last_user, output,
 case when k % 10 in (0,1,2,3,4) then case k % 10 when 3 then 'AbortError' else 'Error' end end as err_name,
 case k % 10 when 0 then 429 when 1 then 503 when 2 then 400 end as http_status,
 case when k % 2 = 0 then 50 + k % 17 end as usage_prompt,
 case when k % 3 <> 0 then 20 + k % 11 end as usage_completion,
 case when k % 4 = 0 then 100 end as usage_total,
 timestamp '2024-01-01 00:00:00' + k * interval '1' second as started_at,
 timestamp '2024-01-01 00:00:00' + (k + 1 + k % 7) * interval '1' second as ended_at
from (select conv_id*100+turn as k, conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as output from conversations) z
where role = 'user'""",
    "chunks": """
select call_id, seq, case when seq=0 then w else ' '||w end as delta from (
 select conv_id*100+turn as call_id, unnest(range(len(string_split(text,' ')))) as seq, unnest(string_split(text,' ')) as w
 from conversations where role='assistant')""",
}


def statement(sql: str, **more: str) -> str:
    """``sql`` with a WITH clause of every derived table it mentions, directly or through another one."""
    known = {**VIEWS, **more}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in known.items():
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "with " + ",\n".join(f"{name} as ({known[name]})" for name in needed) + "\n" + sql
