"""The same results in plain SQL, written from their definitions.

The statements do not follow the Spark plans: they expand every planned day,
use range conditions and window functions, where the jobs use closed forms,
derived keys and aggregates.
"""

from __future__ import annotations

import re

from ..fixed_values import DEFAULT_ROUTINE



def _code(number: str) -> str:
    """Six base-30 digits of a number, spelled out."""
    digits = [f"substr('ABCDEFGHJKMNPQRSTUVWXYZ2345678', "
              f"CAST((({number}) // {30 ** k}) % 30 + 1 AS INTEGER), 1)"
              for k in (5, 4, 3, 2, 1, 0)]
    return "(" + " || ".join(digits) + ")"


def _owner_code(owner: str) -> str:
    return _code(f"({owner} * 7919 + 104729) % {30 ** 6}")


def _digest_code(owner: str, attempt: int) -> str:
    digest = f"substr(md5(CAST({owner} AS VARCHAR) || '#{attempt}'), 1, 12)"
    return _code(f"CAST('0x' || {digest} AS BIGINT) % {30 ** 6}")


def _day_type(d: str) -> str:
    return f"CASE WHEN dayofweek({d}) IN (0, 6) THEN 'weekend' ELSE 'weekday' END"


def _week(d: str) -> str:
    return f"CAST(date_trunc('week', {d}) AS DATE)"


def _month(d: str) -> str:
    return f"CAST(date_trunc('month', {d}) AS DATE)"


def _pct(done: str, planned: str) -> str:
    return (f"CASE WHEN {planned} = 0 THEN 0 ELSE CAST(floor(CAST({done} AS DOUBLE) / "
            f"CAST({planned} AS DOUBLE) * 100 + 0.5) AS INTEGER) END")


def _mins(s: str, e: str) -> str:
    return f"CASE WHEN {e} > {s} THEN {e} - {s} ELSE 0 END"


def _hhmm(m: str) -> str:
    return f"lpad(CAST({m} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0')"


def _dur(m: str) -> str:
    return (f"CASE WHEN {m} >= 60 AND {m} % 60 <> 0 THEN CAST({m} // 60 AS VARCHAR) || 'h ' || "
            f"CAST({m} % 60 AS VARCHAR) || 'm' WHEN {m} >= 60 THEN CAST({m} // 60 AS VARCHAR) "
            f"|| 'h' ELSE CAST({m} % 60 AS VARCHAR) || 'm' END")


def _hide(t: str) -> str:
    # The patterns that define what counts as private.
    return (f"nullif(trim(regexp_replace(regexp_replace({t}, '/\\*.*?\\*/', '', 'gs'), "
            f"'/\\*.*', '', 's'), chr(32) || chr(9) || chr(10)), '')")


def _plain(n: str) -> str:
    return f"regexp_replace(CAST({n} AS VARCHAR), '\\.?0+$', '')"


def _caption(k: str, unit: str) -> str:
    plural = f"CASE WHEN abs({k}) = 1 THEN '' ELSE 's' END"
    return (f"CASE WHEN {k} = 0 THEN 'This {unit}' WHEN {k} < 0 THEN CAST(abs({k}) AS VARCHAR) "
            f"|| ' {unit}' || {plural} || ' ago' ELSE 'In ' || CAST({k} AS VARCHAR) || "
            f"' {unit}' || {plural} END")


def _level(done: str, planned: str) -> str:
    return (f"CASE WHEN {done} = 0 THEN 0 WHEN {planned} = 0 THEN 1 "
            f"WHEN {done} >= {planned} THEN 3 WHEN {done} * 2 >= {planned} THEN 2 ELSE 1 END")


_KIND = ("CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 "
         "WHEN 'signup' THEN 4 ELSE 5 END")
_PAGE_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_AS_OF = "DATE '2024-01-17'"
_FEED = "TIMESTAMP '2024-01-16 00:00:00'"

# Named pieces; a statement pulls in the ones it mentions.
_PIECES: dict[str, str] = {
    "profiles": f"""
        SELECT c_custkey AS owner_id, lower(replace(c_name, '#', '')) || '@example.org' AS email,
               lower(replace(c_name, '#', '')) AS username, {_owner_code('c_custkey')} AS share_code,
               CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS display_name
        FROM customer""",
    "edits": """
        SELECT event_id AS seq, ts, user_id AS owner_id, event_type, value,
               CASE WHEN value > 200 THEN 'e' || CAST(event_id AS VARCHAR)
                    ELSE CAST(user_id AS VARCHAR) || ':' || event_type END AS activity_id,
               value > 200 AS one_off, CAST(ts AS DATE) AS log_date, value >= 20 AS completed,
               CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS actual_start_min,
               CAST(CASE WHEN event_id % 10 = 0 THEN NULL
                         WHEN event_id % 7 = 0 THEN greatest(hour(ts) * 60 + minute(ts) - 5, 0)
                         ELSE least(1439, hour(ts) * 60 + minute(ts) + CAST(floor(value) AS INTEGER))
                    END AS INTEGER) AS actual_end_min,
               CASE event_id % 4
                    WHEN 0 THEN 'done /* private ' || CAST(event_id AS VARCHAR) || ' */ well'
                    WHEN 1 THEN 'ok /* hidden ' || event_type
                    WHEN 2 THEN event_type || ' note ' || CAST(event_id % 17 AS VARCHAR) END AS note,
               event_id % 3 = 0 AS sets_completed, event_id % 3 = 1 AS sets_times,
               event_id % 3 = 2 AS sets_note
        FROM events""",
    "activities": f"""
        SELECT activity_id, owner_id, event_type AS title,
               CASE WHEN 3 * weekend_cents > cents THEN 'weekend' ELSE 'weekday' END AS day_type,
               390 + {_KIND} * 90 AS planned_start_min, 450 + {_KIND} * 90 AS planned_end_min,
               CASE WHEN {_KIND} IN (2, 5) THEN 'focus' WHEN {_KIND} = 4 THEN 'move'
                    ELSE 'rest' END AS category,
               {_KIND} AS sort_order, CAST(NULL AS DATE) AS entry_date,
               CASE WHEN {_KIND} = 2 THEN '#3f6fb0' END AS color,
               CASE WHEN {_KIND} IN (2, 5) THEN owner_id * 2 WHEN {_KIND} = 4 THEN owner_id * 2 + 1
               END AS goal_id, created_at
        FROM (SELECT activity_id, owner_id, event_type, min(ts) AS created_at,
                     sum(CAST(round(value * 100) AS BIGINT)) AS cents,
                     sum(CASE WHEN dayofweek(log_date) IN (0, 6) THEN CAST(round(value * 100) AS BIGINT)
                              ELSE 0 END) AS weekend_cents
              FROM edits WHERE NOT one_off GROUP BY ALL)
        UNION ALL
        SELECT activity_id, owner_id, 'extra ' || event_type, {_day_type('log_date')}, NULL, NULL,
               'rest', 100, log_date, NULL,
               CASE WHEN {_KIND} = 3 THEN owner_id * 2 + 1 END, ts
        FROM edits WHERE one_off""",
    "logs": """
        SELECT owner_id, activity_id, log_date, completed, note, actual_start_min, actual_end_min
        FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, activity_id, log_date
                                           ORDER BY ts DESC, seq DESC) AS rn FROM edits)
        WHERE rn = 1""",
    "goals": """
        SELECT c_custkey * 2 AS goal_id, c_custkey AS owner_id, 'Focus time' AS title,
               'weekly' AS period_type, 'hours' AS metric, CAST(2.5 AS DECIMAL(38,10)) AS target,
               TIMESTAMP '2024-01-01 10:00:00' AS created_at FROM customer
        UNION ALL
        SELECT c_custkey * 2 + 1, c_custkey, 'Moves', 'monthly', 'count',
               CAST(c_custkey % 9 AS DECIMAL(38,10)), TIMESTAMP '2024-01-01 09:00:00' FROM customer""",
    "reflection_edits": """
        SELECT doc_id AS seq, doc_id // 6 AS owner_id,
               CASE doc_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS period_type,
               CASE doc_id % 3 WHEN 0 THEN DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER)
                    WHEN 1 THEN DATE '2024-01-01' + CAST((doc_id // 3) % 5 * 7 AS INTEGER)
                    ELSE DATE '2024-01-01' END AS period_date,
               CASE doc_id % 4
                    WHEN 0 THEN head || '/* ' || mid || ' */' || tail
                    WHEN 1 THEN head || '/*' || mid || tail
                    WHEN 2 THEN head || chr(10) || ' // ' || mid || chr(10) || tail
                    ELSE text END AS content
        FROM (SELECT doc_id, text, substr(text, 1, length(text) // 2) AS head,
                     substr(text, length(text) // 2 + 1, length(text) // 4) AS mid,
                     substr(text, length(text) // 2 + length(text) // 4 + 1) AS tail
              FROM documents)""",
    "reflections": """
        SELECT owner_id, period_type, period_date, content
        FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, period_type, period_date
                                           ORDER BY seq DESC) AS rn FROM reflection_edits)
        WHERE rn = 1""",
    "shares": """
        SELECT owner_id, viewer_id, permission FROM (
            SELECT c_custkey AS owner_id, c_custkey + c_nationkey + 1 AS viewer_id,
                   CASE WHEN c_acctbal < 0 THEN 'edit' ELSE 'view' END AS permission FROM customer
            UNION ALL
            SELECT c_custkey, c_custkey - c_nationkey - 1,
                   CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'edit' ELSE 'view' END
            FROM customer)
        WHERE viewer_id IN (SELECT c_custkey FROM customer)""",
    "share_asks": f"""
        SELECT event_id AS seq, ts, user_id AS owner_id,
               ' ' || lower(CASE WHEN event_type = 'error' THEN '999999'
                                 WHEN event_id % 4 = 0 THEN {_owner_code('user_id')}
                                 ELSE {_owner_code('(user_id + event_id % 4)')} END) || ' ' AS code,
               CASE WHEN value >= 20 THEN 'edit' ELSE 'view' END AS permission
        FROM events""",
    "resolved": """
        SELECT a.seq, a.ts, a.owner_id, p.owner_id AS viewer_id, a.permission,
               CASE WHEN trim(a.code) = '' THEN 'blank' WHEN p.owner_id IS NULL THEN 'unknown code'
                    WHEN p.owner_id = a.owner_id THEN 'own code' ELSE 'granted' END AS outcome
        FROM share_asks a LEFT JOIN profiles p ON p.share_code = upper(trim(a.code))""",
    "share_edits": """
        SELECT event_id AS seq, ts, user_id AS owner_id, user_id + event_id % 4 + 1 AS viewer_id,
               CASE WHEN value >= 20 THEN 'edit' ELSE 'view' END AS permission,
               event_type = 'error' AS removed FROM events""",
    "spine": f"""
        SELECT CAST(g AS DATE) AS d, {_day_type('g')} AS dt
        FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-11', INTERVAL 1 DAY) s(g)""",
    "january": "SELECT d, dt FROM spine WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'",
    "planned": """
        SELECT s.d, a.* FROM activities a JOIN spine s
          ON (a.entry_date IS NULL AND a.day_type = s.dt) OR a.entry_date = s.d""",
    "agenda_rows": """
        SELECT a.*, a.entry_date IS NOT NULL AS one_off, l.activity_id IS NOT NULL AS logged,
               coalesce(l.completed, false) AS completed, l.actual_start_min, l.actual_end_min, l.note
        FROM planned a LEFT JOIN logs l
          ON l.owner_id = a.owner_id AND l.activity_id = a.activity_id AND l.log_date = a.d""",
    "days": """
        SELECT p.owner_id, s.d, s.dt,
               (SELECT count(*) FROM planned x WHERE x.owner_id = p.owner_id AND x.d = s.d) AS planned,
               (SELECT count(*) FROM logs l WHERE l.owner_id = p.owner_id AND l.log_date = s.d
                                              AND l.completed) AS done
        FROM profiles p, spine s""",
    "weeks": f"""
        SELECT owner_id, {_week('d')} AS week_start, CAST(sum(planned) AS BIGINT) AS planned,
               CAST(sum(done) AS BIGINT) AS done
        FROM days WHERE {_week('d')} BETWEEN DATE '2024-01-01' AND DATE '2024-01-29' GROUP BY ALL""",
    "months": """
        SELECT owner_id, DATE '2024-01-01' AS month_start, CAST(sum(planned) AS BIGINT) AS planned,
               CAST(sum(done) AS BIGINT) AS done
        FROM days WHERE d BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY ALL""",
    "goal_spans": """
        SELECT g.*, CASE WHEN period_type = 'weekly' THEN CAST(w AS DATE) ELSE DATE '2024-01-01' END
                    AS period_start,
               CASE WHEN period_type = 'weekly' THEN CAST(w AS DATE) + 6 ELSE DATE '2024-01-31' END
                    AS period_end
        FROM goals g, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAY) s(w)
        WHERE period_type = 'weekly' OR w = TIMESTAMP '2024-01-01'""",
    "progress": f"""
        SELECT g.goal_id, g.owner_id, g.title, g.period_type, g.period_start, g.metric, g.target,
               g.created_at,
               CAST(coalesce(sum(CASE WHEN g.metric = 'count' THEN CAST(l.completed AS INTEGER)
                    ELSE {_mins('l.actual_start_min', 'l.actual_end_min')} END), 0) AS BIGINT) AS actual
        FROM goal_spans g
        LEFT JOIN (SELECT l.*, a.goal_id FROM logs l JOIN activities a USING (activity_id)) l
          ON l.goal_id = g.goal_id AND l.owner_id = g.owner_id
             AND l.log_date BETWEEN g.period_start AND g.period_end
        GROUP BY ALL""",
    "measured": """
        SELECT *, CAST(target AS DOUBLE) * CASE WHEN metric = 'hours' THEN 60 ELSE 1 END AS target_unit
        FROM progress""",
    "goal_rows": f"""
        SELECT *, CASE WHEN target_unit = 0 THEN 0 ELSE least(100, {_pct('actual', 'target_unit')})
                  END AS pct,
               CASE WHEN metric = 'hours' THEN {_dur('actual')} || ' of ' || {_plain('target')} || 'h'
                    ELSE CAST(actual AS VARCHAR) || ' of ' || {_plain('target')} || ' done' END AS label
        FROM measured""",
    "grants": """
        SELECT owner_id AS viewer_id, owner_id, 'edit' AS permission FROM profiles
        UNION ALL SELECT viewer_id, owner_id, permission FROM shares""",
    "agenda_lists": f"""
        SELECT owner_id, d, list({{'title': title, 'category': category,
                 'planned_start': {_hhmm('planned_start_min')}, 'planned_end': {_hhmm('planned_end_min')},
                 'completed': completed, 'actual_start': {_hhmm('actual_start_min')},
                 'actual_end': {_hhmm('actual_end_min')}, 'note': {_hide('note')}}}
                 ORDER BY sort_order, created_at, activity_id) AS items
        FROM agenda_rows GROUP BY ALL""",
    "day_docs": f"""
        SELECT p.owner_id, p.share_code, s.d, CAST(0 AS INTEGER) AS part_no,
               coalesce(p.display_name, p.username) AS owner_name, a.items,
               {_week('s.d')} AS wk, {_month('s.d')} AS mo,
               (SELECT {_hide('r.content')} FROM reflections r WHERE r.owner_id = p.owner_id
                 AND r.period_type = 'weekly' AND r.period_date = {_week('s.d')}) AS week_reflection,
               (SELECT {_hide('r.content')} FROM reflections r WHERE r.owner_id = p.owner_id
                 AND r.period_type = 'monthly' AND r.period_date = {_month('s.d')}) AS month_reflection
        FROM profiles p CROSS JOIN january s
        LEFT JOIN agenda_lists a ON a.owner_id = p.owner_id AND a.d = s.d""",
    "progress_documents": f"""
        SELECT p.owner_id, p.share_code, CAST(0 AS INTEGER) AS part_no, CAST(1 AS INTEGER) AS part_count,
               CAST(to_json({{
            'owner_name': coalesce(p.display_name, p.username),
            'today': coalesce((SELECT items FROM agenda_lists a
                               WHERE a.owner_id = p.owner_id AND a.d = {_AS_OF}), []),
            'week': (SELECT {{'done': done, 'planned': planned}} FROM weeks w
                     WHERE w.owner_id = p.owner_id AND w.week_start = DATE '2024-01-15'),
            'month': (SELECT {{'done': done, 'planned': planned}} FROM months m
                      WHERE m.owner_id = p.owner_id),
            'calendar': (SELECT list({{'d': strftime(d, '%Y-%m-%d'), 'planned': planned, 'done': done}}
                                     ORDER BY d) FROM days x
                         WHERE x.owner_id = p.owner_id AND d IN (SELECT d FROM january)),
            'goals': (SELECT list({{'title': title, 'period': period_type, 'metric': metric,
                                    'target': CAST(target AS DOUBLE), 'actual': actual}}
                                  ORDER BY created_at, goal_id) FROM progress g
                      WHERE g.owner_id = p.owner_id AND period_start =
                            CASE WHEN period_type = 'weekly' THEN DATE '2024-01-15'
                                 ELSE DATE '2024-01-01' END),
            'reflections': {{
                'daily': (SELECT {_hide('content')} FROM reflections r WHERE r.owner_id = p.owner_id
                          AND period_type = 'daily' AND period_date = {_AS_OF}),
                'weekly': (SELECT {_hide('content')} FROM reflections r WHERE r.owner_id = p.owner_id
                           AND period_type = 'weekly' AND period_date = DATE '2024-01-15'),
                'monthly': (SELECT {_hide('content')} FROM reflections r WHERE r.owner_id = p.owner_id
                            AND period_type = 'monthly' AND period_date = DATE '2024-01-01')}}
            }}) AS VARCHAR) AS document
        FROM profiles p""",
    "day_progress_documents": f"""
        SELECT p.owner_id, p.share_code, n.d, CAST(0 AS INTEGER) AS part_no, CAST(1 AS INTEGER) AS part_count,
               CAST(to_json({{
            'owner_name': coalesce(p.display_name, p.username),
            'today': coalesce((SELECT items FROM agenda_lists a
                               WHERE a.owner_id = p.owner_id AND a.d = n.d), []),
            'week': (SELECT {{'done': done, 'planned': planned}} FROM weeks w
                     WHERE w.owner_id = p.owner_id AND w.week_start = {_week('n.d')}),
            'month': (SELECT {{'done': done, 'planned': planned}} FROM months m
                      WHERE m.owner_id = p.owner_id),
            'calendar': (SELECT list({{'d': strftime(d, '%Y-%m-%d'), 'planned': planned, 'done': done}}
                                     ORDER BY d) FROM days x
                         WHERE x.owner_id = p.owner_id AND d IN (SELECT d FROM january)),
            'goals': (SELECT list({{'title': title, 'period': period_type, 'metric': metric,
                                    'target': CAST(target AS DOUBLE), 'actual': actual}}
                                  ORDER BY created_at, goal_id) FROM progress g
                      WHERE g.owner_id = p.owner_id AND period_start =
                            CASE WHEN period_type = 'weekly' THEN {_week('n.d')}
                                 ELSE DATE '2024-01-01' END),
            'reflections': {{
                'daily': (SELECT {_hide('content')} FROM reflections r WHERE r.owner_id = p.owner_id
                          AND period_type = 'daily' AND period_date = n.d),
                'weekly': (SELECT {_hide('content')} FROM reflections r WHERE r.owner_id = p.owner_id
                           AND period_type = 'weekly' AND period_date = {_week('n.d')}),
                'monthly': (SELECT {_hide('content')} FROM reflections r WHERE r.owner_id = p.owner_id
                            AND period_type = 'monthly' AND period_date = DATE '2024-01-01')}}
            }}) AS VARCHAR) AS document
        FROM profiles p CROSS JOIN january n""",
    "forms": f"""
        SELECT event_id AS seq, ts AS created_at, user_id AS owner_id, CAST(ts AS DATE) AS entry_date,
               {_day_type('ts')} AS day_type,
               CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS title,
               CASE WHEN event_id % 4 IN (0, 1) THEN 'rest' ELSE 'focus' END AS category,
               CASE WHEN value >= 20 THEN CAST(hour(ts) * 60 + minute(ts) AS INTEGER) END
                    AS planned_start_min,
               CAST(NULL AS INTEGER) AS planned_end_min,
               CASE WHEN event_id % 5 = 0 THEN user_id * 2 END AS goal_id,
               CASE WHEN event_id % 6 = 0 THEN '#4e944f' END AS color
        FROM events WHERE event_id % 11 <> 0""",
    "goal_texts": """
        SELECT event_id AS seq, user_id AS owner_id,
               CASE WHEN event_id % 13 = 0 THEN '' ELSE ' ' || event_type END AS title,
               CASE WHEN event_id % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS period_type,
               CASE WHEN event_id % 2 = 0 THEN 'hours' ELSE 'count' END AS metric,
               CASE WHEN event_id % 7 = 0 THEN 'many' WHEN event_id % 7 = 1 THEN '0'
                    WHEN event_id % 7 = 2 THEN '-1.5' WHEN event_id % 21 = 3 THEN '123456789.125'
                    WHEN event_id % 21 = 10 THEN '0.004' WHEN event_id % 21 = 17 THEN '0.000000000004'
                    ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS target
        FROM events""",
    "untidy": """
        SELECT seq AS goal_id, owner_id, nullif(title, '') AS title,
               CASE WHEN seq % 9 = 0 THEN 'daily' ELSE period_type END AS period_type,
               CASE WHEN seq % 10 = 0 THEN 'words' ELSE metric END AS metric,
               TRY_CAST(target AS DECIMAL(38,10)) AS target FROM goal_texts""",
    "broken": """
        SELECT *, list_filter([
               CASE WHEN owner_id IS NULL THEN 'owner_id missing' END,
               CASE WHEN title IS NULL THEN 'title missing' END,
               CASE WHEN period_type IS NULL THEN 'period_type missing' END,
               CASE WHEN metric IS NULL THEN 'metric missing' END,
               CASE WHEN target IS NULL THEN 'target missing' END,
               CASE WHEN period_type NOT IN ('weekly', 'monthly') THEN 'period_type not allowed' END,
               CASE WHEN metric NOT IN ('hours', 'count') THEN 'metric not allowed' END
               ], lambda x: x IS NOT NULL) AS violations
        FROM untidy""",
    "patches": f"""
        SELECT activity_id, ts, seq, seq % 6 AS kind,
               CASE WHEN seq % 4 <> 0 THEN 'new ' || event_type END AS title,
               CASE WHEN seq % 4 = 1 THEN 'rest' ELSE 'focus' END AS category,
               CASE WHEN seq % 8 >= 4 THEN '#112233' END AS color,
               CASE WHEN seq % 6 <> 5 AND seq % 5 <> 0 THEN owner_id * 2 END AS goal_id,
               CASE WHEN seq % 10 <> 3 THEN CASE WHEN value >= 20 THEN 'weekend' ELSE 'weekday' END
               END AS day_type,
               CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS planned_start_min
        FROM edits""",
    "newest": """
        SELECT a.activity_id, a.owner_id, a.sort_order, a.title AS old_title, a.category AS old_category,
               a.color AS old_color, a.goal_id AS old_goal_id, a.day_type AS old_day_type,
               a.planned_start_min AS old_planned_start_min, a.planned_end_min AS old_planned_end_min,
               (SELECT max({'ts': ts, 'seq': seq, 'v': title}) FROM patches p
                WHERE p.activity_id = a.activity_id AND kind IN (0, 5) AND p.title IS NOT NULL) AS t,
               (SELECT max({'ts': ts, 'seq': seq, 'v': category}) FROM patches p
                WHERE p.activity_id = a.activity_id AND kind = 1) AS c,
               (SELECT max({'ts': ts, 'seq': seq, 'v': color}) FROM patches p
                WHERE p.activity_id = a.activity_id AND kind = 1) AS k,
               (SELECT max({'ts': ts, 'seq': seq, 'v': goal_id}) FROM patches p
                WHERE p.activity_id = a.activity_id AND kind IN (2, 5)) AS g,
               (SELECT max({'ts': ts, 'seq': seq, 'v': goal_id}) FROM patches p
                WHERE p.activity_id = a.activity_id AND kind = 2) AS tag,
               (SELECT max({'ts': ts, 'seq': seq, 'v': day_type}) FROM patches p
                WHERE p.activity_id = a.activity_id AND kind = 3 AND p.day_type IS NOT NULL) AS y,
               (SELECT max({'ts': ts, 'seq': seq, 'v': planned_start_min}) FROM patches p
                WHERE p.activity_id = a.activity_id AND kind = 4) AS s
        FROM activities a""",
    "typed": """
        SELECT *, CASE WHEN t IS NOT NULL THEN t.v ELSE old_title END AS title,
               CASE WHEN c IS NOT NULL THEN c.v ELSE old_category END AS category,
               CASE WHEN k IS NOT NULL THEN k.v ELSE old_color END AS color,
               CASE WHEN g IS NOT NULL THEN g.v ELSE old_goal_id END AS goal_id,
               CASE WHEN y IS NOT NULL THEN y.v ELSE old_day_type END AS day_type,
               CASE WHEN s IS NOT NULL THEN s.v ELSE old_planned_start_min END AS planned_start_min,
               CASE WHEN s IS NULL THEN old_planned_end_min END AS planned_end_min
        FROM newest""",
    "day_places": """
        SELECT *, row_number() OVER (PARTITION BY owner_id, d ORDER BY sort_order, created_at, activity_id)
                  - 1 AS pos, count(*) OVER (PARTITION BY owner_id, d) AS n FROM planned""",
    "drags": """
        SELECT owner_id, log_date AS d, list(seq % 4 * 4 + (seq // 4) % 4 ORDER BY seq) AS moves
        FROM edits GROUP BY ALL""",
    "dragged": """
        SELECT p.owner_id, p.d, p.activity_id, p.sort_order AS old_sort_order, p.pos,
               list_filter(m.moves, lambda x: x // 4 <> x % 4 AND x // 4 < p.n AND x % 4 < p.n) AS moves
        FROM day_places p JOIN drags m ON m.owner_id = p.owner_id AND m.d = p.d""",
    "closed": "SELECT c_custkey AS owner_id FROM customer WHERE c_acctbal < 0",
    "field_words": """
        SELECT *, row_number() OVER (PARTITION BY owner_id, activity_id, log_date, sets_completed
                                     ORDER BY ts DESC, seq DESC) AS rc,
               row_number() OVER (PARTITION BY owner_id, activity_id, log_date, sets_times
                                  ORDER BY ts DESC, seq DESC) AS rt,
               row_number() OVER (PARTITION BY owner_id, activity_id, log_date, sets_note
                                  ORDER BY ts DESC, seq DESC) AS rn
        FROM edits""",
    "folded": """
        SELECT owner_id, activity_id, log_date,
               coalesce(max(CASE WHEN sets_completed AND rc = 1 THEN completed END), false) AS completed,
               max(CASE WHEN sets_times AND rt = 1 THEN actual_start_min END) AS actual_start_min,
               max(CASE WHEN sets_times AND rt = 1 THEN actual_end_min END) AS actual_end_min,
               max(CASE WHEN sets_note AND rn = 1 THEN note END) AS note
        FROM field_words GROUP BY ALL""",
    "stream_tallies": f"""
        SELECT e.owner_id, e.log_date AS d,
               count(f.activity_id) FILTER (WHERE f.completed) AS done,
               (SELECT count(*) FROM planned p WHERE p.owner_id = e.owner_id AND p.d = e.log_date) AS total,
               CAST(coalesce(sum({_mins('f.actual_start_min', 'f.actual_end_min')}), 0) AS BIGINT) AS minutes
        FROM (SELECT DISTINCT owner_id, log_date FROM edits) e
        LEFT JOIN (SELECT f.* FROM folded f JOIN planned p ON p.owner_id = f.owner_id
                   AND p.activity_id = f.activity_id AND p.d = f.log_date) f
          ON f.owner_id = e.owner_id AND f.log_date = e.log_date
        GROUP BY ALL""",
    "words": f"""
        SELECT owner_id, activity_id, log_date, completed, actual_start_min, actual_end_min, note,
               ts, seq, sets_completed, sets_times, sets_note FROM edits WHERE ts >= {_FEED}
        UNION ALL
        SELECT owner_id, activity_id, log_date, completed, actual_start_min, actual_end_min, note,
               TIMESTAMP '1970-01-01', -1, true, true, true
        FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, activity_id, log_date
                                           ORDER BY ts DESC, seq DESC) AS k
              FROM edits WHERE ts < {_FEED}) WHERE k = 1""",
    "ranked_words": """
        SELECT *, row_number() OVER (PARTITION BY owner_id, activity_id, log_date, sets_completed
                                     ORDER BY ts DESC, seq DESC) AS rc,
               row_number() OVER (PARTITION BY owner_id, activity_id, log_date, sets_times
                                  ORDER BY ts DESC, seq DESC) AS rt,
               row_number() OVER (PARTITION BY owner_id, activity_id, log_date, sets_note
                                  ORDER BY ts DESC, seq DESC) AS rn
        FROM words""",
}

_ROUTINE = ", ".join(
    "('{}', '{}', {}, {}, '{}', {})".format(
        title, day_type, int(start[:2]) * 60 + int(start[3:]), int(end[:2]) * 60 + int(end[3:]),
        category, position)
    for title, day_type, start, end, category, position in DEFAULT_ROUTINE)

# The key of each table as text.
_KEYS = {
    "profiles": "CAST(owner_id AS VARCHAR)", "activities": "activity_id",
    "logs": "concat_ws('|', owner_id, activity_id, strftime(log_date, '%Y-%m-%d'))",
    "reflections": "concat_ws('|', owner_id, period_type, strftime(period_date, '%Y-%m-%d'))",
    "shares": "concat_ws('|', owner_id, viewer_id)", "goals": "CAST(goal_id AS VARCHAR)"}
_CLOSED = "owner_id IN (SELECT owner_id FROM closed)"
_REMOVED = {name: _CLOSED for name in _KEYS} | {
    "shares": f"{_CLOSED} OR viewer_id IN (SELECT owner_id FROM closed)",
    "goals": f"{_CLOSED} OR target = 0",
    "activities": f"{_CLOSED} OR title IN ('error', 'extra error')",
    "logs": f"{_CLOSED} OR activity_id IN (SELECT activity_id FROM activities WHERE title IN ('error', 'extra error'))"}

_STATEMENTS: dict[str, str] = {
    "week_adherence": f"SELECT *, {_pct('done', 'planned')} AS pct FROM weeks",
    "month_adherence": f"SELECT *, {_pct('done', 'planned')} AS pct FROM months",
    "calendar_days": f"""
        SELECT owner_id, d, dt AS day_type, planned, done, {_level('done', 'planned')} AS level
        FROM days WHERE d IN (SELECT d FROM january)""",
    "month_grid": "SELECT owner_id, DATE '2024-01-01' AS month_start, CAST((day(d) - 1) // 7 AS INTEGER) "
                  "AS grid_row, " + ", ".join(
        f"max(CASE WHEN isodow(d) = {k} THEN CAST(day(d) AS VARCHAR) || '|' || CAST(done AS VARCHAR) || "
        f"'/' || CAST(planned AS VARCHAR) || '|' || CAST({_level('done', 'planned')} AS VARCHAR) END) AS {n}"
        for k, n in enumerate(["mon", "tue", "wed", "thu", "fri", "sat", "sun"], 1))
        + " FROM days WHERE d IN (SELECT d FROM january) GROUP BY ALL",
    "day_tally": f"""
        SELECT *, d > {_AS_OF} AS is_future,
               CASE WHEN d > {_AS_OF} THEN CAST(total AS VARCHAR) || ' planned'
                    ELSE CAST(done AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' done · ' ||
                         {_dur('minutes')} || ' active' END AS tally
        FROM (SELECT p.owner_id, s.d, count(a.activity_id) AS total,
                     count(*) FILTER (WHERE a.completed) AS done,
                     CAST(coalesce(sum({_mins('a.actual_start_min', 'a.actual_end_min')}), 0) AS BIGINT)
                     AS minutes
              FROM profiles p CROSS JOIN january s
              LEFT JOIN agenda_rows a ON a.owner_id = p.owner_id AND a.d = s.d GROUP BY ALL)""",
    "category_minutes": f"""
        SELECT *, {_dur('minutes')} AS label FROM (
            SELECT owner_id, d, category,
                   CAST(sum({_mins('actual_start_min', 'actual_end_min')}) AS BIGINT) AS minutes
            FROM agenda_rows WHERE d IN (SELECT d FROM january) GROUP BY ALL) WHERE minutes > 0""",
    "period_minutes": f"""
        SELECT owner_id, 'weekly' AS period_type, {_week('log_date')} AS period_start,
               CAST(sum(actual_end_min - actual_start_min) AS BIGINT) AS minutes
        FROM logs WHERE actual_end_min > actual_start_min GROUP BY ALL
        UNION ALL
        SELECT owner_id, 'monthly', {_month('log_date')},
               CAST(sum(actual_end_min - actual_start_min) AS BIGINT)
        FROM logs WHERE actual_end_min > actual_start_min GROUP BY ALL""",
    "planned_occurrences": """
        SELECT owner_id, d, activity_id, title, day_type, sort_order
        FROM planned WHERE d IN (SELECT d FROM january)""",
    "agenda": """
        SELECT owner_id, d, activity_id, title, category, sort_order, one_off, logged, completed,
               planned_start_min, planned_end_min, actual_start_min, actual_end_min, note
        FROM agenda_rows WHERE d IN (SELECT d FROM january)""",
    "week_report": f"""
        SELECT w.*, {_pct('done', 'planned')} AS pct, r.content AS reflection,
               {_caption("((w.week_start - DATE '2024-01-15') // 7)", 'week')} AS caption,
               strftime(w.week_start, '%a, %b %-d') AS first_day,
               strftime(w.week_start + 6, '%a, %b %-d') AS last_day
        FROM weeks w LEFT JOIN reflections r ON r.owner_id = w.owner_id
             AND r.period_type = 'weekly' AND r.period_date = w.week_start""",
    "month_report": f"""
        SELECT m.*, {_pct('done', 'planned')} AS pct, r.content AS reflection,
               'This month' AS caption, 'January 2024' AS month_name
        FROM months m LEFT JOIN reflections r ON r.owner_id = m.owner_id
             AND r.period_type = 'monthly' AND r.period_date = m.month_start""",
    "_detail": f"""
        SELECT a.owner_id, a.d, a.activity_id, a.title, a.category, a.sort_order, a.one_off,
               g.title AS goal_title, a.d > {_AS_OF} AS is_future,
               CASE WHEN a.d <= {_AS_OF} THEN a.completed END AS completed,
               'Planned ' || coalesce({_hhmm('a.planned_start_min')}, '—') || '–' ||
               coalesce({_hhmm('a.planned_end_min')}, '—') ||
               CASE WHEN a.actual_start_min IS NOT NULL OR a.actual_end_min IS NOT NULL
                    THEN ' · actual ' || coalesce({_hhmm('a.actual_start_min')}, '—') || '–' ||
                         coalesce({_hhmm('a.actual_end_min')}, '—') ELSE '' END AS times,
               CAST({_mins('a.actual_start_min', 'a.actual_end_min')} AS BIGINT) AS minutes, a.note
        FROM agenda_rows a LEFT JOIN goals g ON g.goal_id = a.goal_id AND g.owner_id = a.owner_id""",
    "time_labels": f"""
        SELECT seq, strftime(log_date, '%Y-%m-%d') AS iso, strftime(log_date, '%A, %B %-d') AS long_label,
               strftime(log_date, '%a, %b %-d') AS short_label, strftime(log_date, '%B %Y') AS month_label,
               {_day_type('log_date')} AS day_type, {_week('log_date')} AS week_start,
               {_week('log_date')} + 6 AS week_end, {_month('log_date')} AS month_start,
               last_day(log_date) AS month_end, {_week('log_date')} - 14 AS two_weeks_before,
               CAST({_month('log_date')} + INTERVAL 1 MONTH AS DATE) AS next_month,
               {_caption(f"(({_week('log_date')} - DATE '2024-01-15') // 7)", 'week')} AS week_caption,
               coalesce({_hhmm('actual_start_min')}, '') AS start_text,
               coalesce({_hhmm('actual_end_min')}, '—') AS end_text, actual_start_min AS start_again,
               {_dur(f"({_mins('actual_start_min', 'actual_end_min')})")} AS active,
               log_date > {_AS_OF} AS is_future
        FROM edits""",
    "goal_progress": """
        SELECT goal_id, owner_id, period_type, period_start, metric, actual, pct FROM goal_rows""",
    "goal_labels": "SELECT goal_id, period_start, title, target_unit, label FROM goal_rows",
    "goals_report": f"""
        SELECT goal_id, owner_id, title, period_start, CASE WHEN period_type = 'weekly'
               THEN period_start + 6 ELSE last_day(period_start) END AS period_end, actual, pct,
               label || ' (' || CAST(pct AS VARCHAR) || '%) · this ' ||
               CASE WHEN period_type = 'weekly' THEN 'week' ELSE 'month' END AS caption
        FROM goal_rows WHERE period_start = CASE WHEN period_type = 'weekly' THEN DATE '2024-01-15'
                                                 ELSE DATE '2024-01-01' END""",
    "redacted_notes": f"SELECT seq, {_hide('note')} AS note FROM edits",
    "redacted_reflections": f"""
        SELECT seq, {_hide('content')} AS without_blocks,
               nullif(array_to_string(list_filter(string_split(content, chr(10)),
                   lambda x: NOT starts_with(ltrim(x), '//')), chr(10)), '') AS without_lines
        FROM reflection_edits""",
    "public_day": """
        SELECT owner_id, share_code, d, part_no, CAST(1 AS INTEGER) AS part_count, CAST(to_json({
                 'owner_name': owner_name, 'date': strftime(d, '%Y-%m-%d'), 'activities': coalesce(items, []),
                 'week_start': strftime(wk, '%Y-%m-%d'), 'week_reflection': week_reflection,
                 'month_start': strftime(mo, '%Y-%m-%d'), 'month_reflection': month_reflection}) AS VARCHAR)
               AS document
        FROM day_docs""",
    "sql_strip_private": f"""
        SELECT 'note' AS kind, seq, {_hide('note')} AS shown FROM edits
        UNION ALL SELECT 'reflection', seq, {_hide('content')} FROM reflection_edits""",
    "sql_access": """
        SELECT event_id AS seq, user_id AS owner_id, user_id + event_id % 6 AS author_id,
               event_id % 6 = 0 OR EXISTS (SELECT 1 FROM shares s WHERE s.owner_id = e.user_id
                 AND s.viewer_id = e.user_id + e.event_id % 6) AS may_view,
               event_id % 6 = 0 OR EXISTS (SELECT 1 FROM shares s WHERE s.owner_id = e.user_id
                 AND s.viewer_id = e.user_id + e.event_id % 6 AND s.permission = 'edit') AS may_edit
        FROM events e""",
    "sql_editable_logs": """
        SELECT e.seq, l.activity_id, l.log_date FROM edits e
        JOIN logs l ON l.owner_id = e.owner_id AND l.activity_id = e.activity_id AND l.log_date = e.log_date
        WHERE e.seq % 6 = 0 OR EXISTS (SELECT 1 FROM shares s WHERE s.owner_id = e.owner_id
          AND s.viewer_id = e.owner_id + e.seq % 6 AND s.permission = 'edit')""",
    "sql_public_schedule": """
        SELECT r.seq, coalesce(p.display_name, p.username) AS owner_name, a.title, a.day_type,
               a.planned_start_min, a.planned_end_min, a.category, a.sort_order
        FROM share_asks r JOIN profiles p ON p.share_code = upper(trim(r.code))
        JOIN activities a ON a.owner_id = p.owner_id WHERE a.entry_date IS NULL""",
    "sql_public_day": """
        SELECT r.seq, CAST(to_json({
                 'owner_name': owner_name, 'date': strftime(d, '%Y-%m-%d'), 'activities': coalesce(items, []),
                 'week_start': strftime(wk, '%Y-%m-%d'), 'week_reflection': week_reflection,
                 'month_start': strftime(mo, '%Y-%m-%d'), 'month_reflection': month_reflection}) AS VARCHAR)
               AS document
        FROM share_asks r JOIN day_docs x ON x.share_code = upper(trim(r.code)) AND x.d = CAST(r.ts AS DATE)""",
    "sql_public_progress": """
        SELECT owner_id, share_code, document FROM progress_documents""",
    "goals_by_day": f"""
        SELECT g.goal_id, g.owner_id, n.d, g.period_start, CASE WHEN g.period_type = 'weekly'
               THEN g.period_start + 6 ELSE last_day(g.period_start) END AS period_end, g.actual, t.so_far, g.pct,
               CASE WHEN g.target_unit = 0 THEN 0 ELSE least(100, {_pct('t.so_far', 'g.target_unit')}) END AS pct_so_far,
               label || ' (' || CAST(g.pct AS VARCHAR) || '%) · this ' ||
               CASE WHEN g.period_type = 'weekly' THEN 'week' ELSE 'month' END AS caption
        FROM goal_rows g JOIN january n ON n.d BETWEEN g.period_start
             AND CASE WHEN g.period_type = 'weekly' THEN g.period_start + 6 ELSE last_day(g.period_start) END
        JOIN (SELECT g.goal_id, n.d, CAST(coalesce(sum(CASE WHEN g.metric = 'count' THEN CAST(l.completed AS INTEGER)
                     ELSE {_mins('l.actual_start_min', 'l.actual_end_min')} END), 0) AS BIGINT) AS so_far
              FROM goal_spans g JOIN january n ON n.d BETWEEN g.period_start AND CASE
                   WHEN g.period_type = 'weekly' THEN g.period_start + 6 ELSE last_day(g.period_start) END
              LEFT JOIN (SELECT l.*, a.goal_id FROM logs l JOIN activities a USING (activity_id)) l
                ON l.goal_id = g.goal_id AND l.owner_id = g.owner_id
                   AND l.log_date BETWEEN g.period_start AND n.d
              GROUP BY g.goal_id, n.d) t ON t.goal_id = g.goal_id AND t.d = n.d""",
    "totals_to_date": f"""
        SELECT *, {_pct('week_done_to_date', 'week_planned_to_date')} AS week_pct_to_date,
               {_pct('month_done_to_date', 'month_planned_to_date')} AS month_pct_to_date
        FROM (SELECT n.owner_id, n.d, {_week('n.d')} AS week_start, {_month('n.d')} AS month_start,
            CAST(sum(CASE WHEN {_week('x.d')} = {_week('n.d')} AND x.d <= n.d THEN x.planned END) AS BIGINT) AS week_planned_to_date,
            CAST(sum(CASE WHEN {_week('x.d')} = {_week('n.d')} AND x.d <= n.d THEN x.done END) AS BIGINT) AS week_done_to_date,
            CAST(sum(CASE WHEN {_week('x.d')} = {_week('n.d')} THEN x.planned END) AS BIGINT) AS week_planned,
            CAST(sum(CASE WHEN {_week('x.d')} = {_week('n.d')} THEN x.done END) AS BIGINT) AS week_done,
            CAST(sum(CASE WHEN {_month('x.d')} = {_month('n.d')} AND x.d <= n.d THEN x.planned END) AS BIGINT) AS month_planned_to_date,
            CAST(sum(CASE WHEN {_month('x.d')} = {_month('n.d')} AND x.d <= n.d THEN x.done END) AS BIGINT) AS month_done_to_date,
            CAST(sum(CASE WHEN {_month('x.d')} = {_month('n.d')} THEN x.planned END) AS BIGINT) AS month_planned,
            CAST(sum(CASE WHEN {_month('x.d')} = {_month('n.d')} THEN x.done END) AS BIGINT) AS month_done
          FROM days n JOIN days x ON x.owner_id = n.owner_id
          WHERE n.d IN (SELECT d FROM january) GROUP BY n.owner_id, n.d)""",
    "progress_by_day": "SELECT * FROM day_progress_documents",
    "past_reflections": f"""
        SELECT owner_id, d, CASE WHEN wk <> DATE '2024-01-15' THEN week_reflection END AS week_reflection,
               CASE WHEN mo <> DATE '2024-01-01' THEN month_reflection END AS month_reflection
        FROM day_docs""",
    "public_progress": "SELECT * FROM progress_documents",
    "public_schedule": """
        SELECT p.share_code, coalesce(p.display_name, p.username) AS owner_name, a.title, a.day_type,
               a.planned_start_min, a.planned_end_min, a.category, a.sort_order
        FROM profiles p JOIN activities a ON a.owner_id = p.owner_id WHERE a.entry_date IS NULL""",
    "public_schedule_with_one_offs": """
        SELECT p.share_code, coalesce(p.display_name, p.username) AS owner_name, a.title, a.day_type,
               a.planned_start_min, a.planned_end_min, a.category, a.sort_order
        FROM profiles p JOIN activities a ON a.owner_id = p.owner_id""",
    "schedules_by_code": """
        SELECT p.share_code, coalesce(p.display_name, p.username) AS owner_name, a.title, a.day_type,
               a.planned_start_min, a.planned_end_min, a.category, a.sort_order
        FROM profiles p JOIN activities a ON a.owner_id = p.owner_id
        WHERE a.entry_date IS NULL AND p.share_code IN (SELECT upper(trim(code)) FROM share_asks)""",
    "schedules_from_code_table": """
        SELECT p.share_code, coalesce(p.display_name, p.username) AS owner_name, a.title, a.day_type,
               a.planned_start_min, a.planned_end_min, a.category, a.sort_order
        FROM profiles p JOIN activities a ON a.owner_id = p.owner_id
        WHERE a.entry_date IS NULL AND p.share_code IN (SELECT upper(trim(code)) FROM share_asks)""",
    "share_lists": """
        SELECT s.owner_id AS person_id, 'out' AS direction, s.viewer_id AS other_id,
               coalesce(nullif(p.display_name, ''), nullif(p.username, ''), 'Someone') AS other_name,
               p.username AS other_username, s.permission
        FROM shares s JOIN profiles p ON p.owner_id = s.viewer_id
        UNION ALL
        SELECT s.viewer_id, 'in', s.owner_id,
               coalesce(nullif(p.display_name, ''), nullif(p.username, ''), 'Someone'),
               p.username, s.permission
        FROM shares s JOIN profiles p ON p.owner_id = s.owner_id""",
    "share_requests": "SELECT seq, owner_id, viewer_id, permission, outcome FROM resolved",
    "granted_shares": """
        SELECT owner_id, viewer_id, permission
        FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, viewer_id ORDER BY ts DESC, seq DESC) k
              FROM resolved WHERE outcome = 'granted') WHERE k = 1""",
    "visible_rows": """
        SELECT p.owner_id AS viewer_id,
            (SELECT count(*) FROM activities x JOIN grants g USING (owner_id) WHERE g.viewer_id = p.owner_id) AS activities,
            (SELECT count(*) FROM logs x JOIN grants g USING (owner_id) WHERE g.viewer_id = p.owner_id) AS logs,
            (SELECT count(*) FROM reflections x JOIN grants g USING (owner_id) WHERE g.viewer_id = p.owner_id) AS reflections,
            (SELECT count(*) FROM goals x JOIN grants g USING (owner_id) WHERE g.viewer_id = p.owner_id) AS goals,
            (SELECT count(*) FROM shares s WHERE s.owner_id = p.owner_id OR s.viewer_id = p.owner_id) AS shares
        FROM profiles p""",
    "visible_activities": """
        SELECT g.viewer_id, x.owner_id, x.activity_id, x.title, x.day_type, x.entry_date FROM activities x JOIN grants g ON g.owner_id = x.owner_id""",
    "visible_logs": """
        SELECT g.viewer_id, x.owner_id, x.activity_id, x.log_date, x.completed, x.note,
               x.actual_start_min, x.actual_end_min FROM logs x JOIN grants g ON g.owner_id = x.owner_id""",
    "visible_reflections": """
        SELECT g.viewer_id, x.owner_id, x.period_type, x.period_date, x.content FROM reflections x JOIN grants g ON g.owner_id = x.owner_id""",
    "visible_goals": """
        SELECT g.viewer_id, x.owner_id, x.goal_id, x.title, x.period_type, x.metric FROM goals x JOIN grants g ON g.owner_id = x.owner_id""",
    "editable_owners": "SELECT viewer_id, owner_id FROM grants WHERE permission = 'edit'",
    "edit_permissions": """
        SELECT event_id AS seq, user_id AS owner_id, user_id + event_id % 6 AS author_id,
               EXISTS (SELECT 1 FROM grants g WHERE g.owner_id = e.user_id AND g.permission = 'edit'
                       AND g.viewer_id = e.user_id + e.event_id % 6) AS may_write_logs,
               event_id % 6 = 0 AS may_write_shares
        FROM events e""",
    "shared_templates": """
        SELECT g.viewer_id, a.owner_id, a.activity_id, a.title, a.day_type, a.sort_order
        FROM activities a JOIN shares g ON g.owner_id = a.owner_id WHERE a.entry_date IS NULL""",
    "readable_shares": """
        SELECT p.owner_id AS reader_id, s.owner_id, s.viewer_id, s.permission
        FROM shares s JOIN profiles p ON p.owner_id = s.owner_id OR p.owner_id = s.viewer_id""",
    "logs_upsert": """
        SELECT owner_id, activity_id, log_date, completed, note, actual_start_min, actual_end_min, seq
        FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, activity_id, log_date
                                           ORDER BY ts DESC, seq DESC) AS k FROM edits) WHERE k = 1""",
    "logs_upsert_by_month": """
        SELECT owner_id, activity_id, log_date, completed, note, actual_start_min, actual_end_min, seq
        FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, activity_id, log_date
                                           ORDER BY ts DESC, seq DESC) AS k FROM edits) WHERE k = 1""",
    "logs_patch_merge": "SELECT * FROM folded",
    "logs_patched": """
        SELECT owner_id, activity_id, log_date,
               coalesce(max(CASE WHEN sets_completed AND rc = 1 THEN completed END), false) AS completed,
               max(CASE WHEN sets_times AND rt = 1 THEN actual_start_min END) AS actual_start_min,
               max(CASE WHEN sets_times AND rt = 1 THEN actual_end_min END) AS actual_end_min,
               max(CASE WHEN sets_note AND rn = 1 THEN note END) AS note
        FROM ranked_words GROUP BY ALL""",
    "note_changes": f"""
        SELECT n.owner_id, n.activity_id, n.log_date, o.note AS old_note, n.note
        FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, activity_id, log_date
                                           ORDER BY ts DESC, seq DESC) AS k
              FROM edits WHERE sets_note AND ts >= {_FEED}) n
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY owner_id, activity_id, log_date
                                                ORDER BY ts DESC, seq DESC) AS k
                   FROM edits WHERE ts < {_FEED}) o
          ON o.owner_id = n.owner_id AND o.activity_id = n.activity_id AND o.log_date = n.log_date
             AND o.k = 1
        WHERE n.k = 1 AND coalesce(n.note, '') <> coalesce(o.note, '')""",
    "reflections_upsert": "SELECT * FROM reflections",
    "shares_upsert": """
        SELECT owner_id, viewer_id, permission FROM (
            SELECT *, row_number() OVER (PARTITION BY owner_id, viewer_id
                                         ORDER BY ts DESC NULLS LAST, seq DESC NULLS LAST) AS k
            FROM (SELECT owner_id, viewer_id, permission, ts, seq, removed FROM share_edits
                  UNION ALL SELECT owner_id, viewer_id, permission, NULL, NULL, false FROM shares))
        WHERE k = 1 AND NOT removed""",
    "clean_activities": """
        SELECT seq, owner_id, entry_date, title, category, planned_start_min, planned_end_min, goal_id,
               color FROM forms""",
    "clean_goals": """
        SELECT seq, owner_id, trim(title) AS title, period_type, metric,
               CAST(TRY_CAST(target AS DECIMAL(38,10)) AS DOUBLE) AS target
        FROM goal_texts WHERE title <> '' AND TRY_CAST(target AS DECIMAL(38,10)) > 0""",
    "insert_positions": """
        SELECT f.seq, f.owner_id, f.entry_date, f.title, CAST(
            greatest(0, coalesce((SELECT max(a.sort_order) FROM activities a WHERE a.owner_id = f.owner_id
                AND ((a.entry_date IS NULL AND a.day_type = f.day_type) OR a.entry_date = f.entry_date)), 0))
            + row_number() OVER (PARTITION BY f.owner_id, f.entry_date ORDER BY f.created_at, f.seq)
            AS INTEGER) AS sort_order
        FROM forms f""",
    "template_positions": """
        SELECT f.seq, f.owner_id, f.day_type, CAST(
            greatest(0, coalesce((SELECT max(a.sort_order) FROM activities a WHERE a.owner_id = f.owner_id
                AND a.entry_date IS NULL AND a.day_type = f.day_type), 0))
            + row_number() OVER (PARTITION BY f.owner_id, f.day_type ORDER BY f.created_at, f.seq)
            AS INTEGER) AS sort_order
        FROM forms f""",
    "changed_rows": """
        SELECT activity_id, old_title, old_category, old_color, old_goal_id, old_day_type,
               old_planned_start_min, old_planned_end_min, title, category, color, goal_id, day_type,
               planned_start_min, planned_end_min
        FROM typed WHERE old_title <> title OR old_category <> category
              OR old_color IS DISTINCT FROM color OR old_goal_id IS DISTINCT FROM goal_id
              OR old_day_type <> day_type OR old_planned_start_min IS DISTINCT FROM planned_start_min
              OR old_planned_end_min IS DISTINCT FROM planned_end_min""",
    "patched_activities": """
        SELECT activity_id, owner_id, sort_order, title, category, color, goal_id, day_type,
               planned_start_min, planned_end_min FROM typed""",
    "tagged_activities": """
        SELECT activity_id, old_title, old_category, old_color, old_goal_id, old_day_type,
               old_planned_start_min, old_planned_end_min, old_title AS title, old_category AS category,
               old_color AS color, tag.v AS goal_id, old_day_type AS day_type,
               old_planned_start_min AS planned_start_min, old_planned_end_min AS planned_end_min
        FROM newest WHERE tag IS NOT NULL AND tag.v IS DISTINCT FROM old_goal_id""",
    "reorder_changes": """
        SELECT owner_id, d, activity_id, old_sort_order, CAST(sort_order AS INTEGER) AS sort_order FROM (
            SELECT *, list_reduce(list_prepend(pos, moves), lambda p, m:
                CASE WHEN p = m // 4 THEN m % 4
                     WHEN p > m // 4 AND p <= m % 4 THEN p - 1
                     WHEN p < m // 4 AND p >= m % 4 THEN p + 1 ELSE p END) AS sort_order
            FROM dragged WHERE len(moves) > 0)
        WHERE old_sort_order <> sort_order""",
    "seed_defaults": f"""
        SELECT p.owner_id, r.*, CAST(p.owner_id AS VARCHAR) || ':default:' || r.day_type || ':' ||
               CAST(r.sort_order AS VARCHAR) AS activity_id
        FROM profiles p CROSS JOIN (VALUES {_ROUTINE})
             r(title, day_type, planned_start_min, planned_end_min, category, sort_order)
        WHERE p.owner_id NOT IN (SELECT owner_id FROM activities)""",
    "cascade_delete": """
        SELECT owner_id, activity_id, log_date,
               CASE WHEN activity_id IN (SELECT activity_id FROM activities
                                         WHERE title IN ('error', 'extra error'))
                    THEN 'removed' ELSE 'kept' END AS fate
        FROM logs""",
    "goal_unlink": """
        SELECT activity_id, owner_id, title,
               CASE WHEN goal_id NOT IN (SELECT goal_id FROM goals WHERE target = 0) THEN goal_id END AS goal_id
        FROM activities""",
    "owner_erasure": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {key} AS row_key FROM {name} "
        f"WHERE owner_id NOT IN (SELECT owner_id FROM closed)"
        + (" AND viewer_id NOT IN (SELECT owner_id FROM closed)" if name == "shares" else "")
        for name, key in _KEYS.items()),
    "removals_by_reference": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {key} AS row_key, CASE WHEN {_REMOVED[name]} THEN 'removed' "
        f"ELSE 'kept' END AS fate FROM {name}" for name, key in _KEYS.items()) + f"""
        UNION ALL SELECT 'activities', {_KEYS['activities']}, 'unlinked' FROM activities
        WHERE NOT ({_REMOVED['activities']}) AND goal_id IN (SELECT goal_id FROM goals WHERE {_REMOVED['goals']})""",
    "tables_round_trip": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {key} AS row_key, "
        f"{'true' if name == 'activities' else 'false'} AS goal_lost FROM {name}"
        for name, key in _KEYS.items()),
    "logs_round_trip": """
        SELECT owner_id, activity_id, log_date, completed, note, actual_start_min, actual_end_min
        FROM logs WHERE log_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'""",
    "table_violations": " UNION ALL ".join([
        f"SELECT '{name}' AS table_name, {key} AS row_key, '{rule}' AS violations FROM {name} "
        f"WHERE owner_id % {k} = 0"
        for name, rule, k in (
            ("profiles", "email missing", 6), ("activities", "day_type not allowed", 5),
            ("logs", "completed missing", 7), ("shares", "permission not allowed", 3))
        for key in (_KEYS[name],)]
        + ["SELECT 'reflections' AS table_name, concat_ws('|', owner_id, 'yearly', "
           "strftime(period_date, '%Y-%m-%d')) AS row_key, 'period_type not allowed' AS violations "
           "FROM reflections WHERE owner_id % 4 = 0",
           "SELECT 'goals', CAST(goal_id AS VARCHAR), array_to_string(violations, '; ') FROM broken "
           "WHERE len(violations) > 0"]),
    "constraint_violations": """
        SELECT goal_id, array_to_string(violations, '; ') AS violations FROM broken""",
    "quarantined_goals": """
        SELECT goal_id, CAST(len(violations) AS BIGINT) AS rules_broken FROM broken
        WHERE len(violations) > 0""",
    "valid_goals": """
        SELECT goal_id, owner_id, title, period_type, metric FROM broken WHERE len(violations) = 0""",
    "orphans": " UNION ALL ".join(
        [f"SELECT '{name}' AS table_name, 'owner_id -> profiles' AS reference, {key} AS row_key, "
         f"CAST(owner_id AS VARCHAR) AS missing_value FROM {name} WHERE owner_id IN (SELECT owner_id FROM closed)"
         for name, key in (
             ("activities", "activity_id"),
             ("logs", "concat_ws('|', owner_id, activity_id, strftime(log_date, '%Y-%m-%d'))"),
             ("reflections", "concat_ws('|', owner_id, period_type, strftime(period_date, '%Y-%m-%d'))"),
             ("shares", "concat_ws('|', owner_id, viewer_id)"),
             ("(SELECT * FROM goals WHERE target <> 0)", "CAST(goal_id AS VARCHAR)"))]
        + ["SELECT 'shares', 'viewer_id -> profiles', concat_ws('|', owner_id, viewer_id), "
           "CAST(viewer_id AS VARCHAR) FROM shares WHERE viewer_id IN (SELECT owner_id FROM closed)",
           "SELECT 'activities', 'goal_id -> goals', activity_id, CAST(goal_id AS VARCHAR) "
           "FROM activities WHERE goal_id IN (SELECT goal_id FROM goals WHERE target = 0)"]
    ).replace("'(SELECT * FROM goals WHERE target <> 0)' AS table_name", "'goals' AS table_name"),
    "duplicate_keys": """
        SELECT 'logs' AS table_name, 'owner_id,activity_id,log_date' AS key_columns,
               concat_ws('|', owner_id, activity_id, strftime(log_date, '%Y-%m-%d')) AS key_value,
               count(*) AS n FROM edits GROUP BY ALL HAVING count(*) > 1
        UNION ALL
        SELECT 'reflections', 'owner_id,period_type,period_date',
               concat_ws('|', owner_id, period_type, strftime(period_date, '%Y-%m-%d')), count(*)
        FROM reflection_edits GROUP BY ALL HAVING count(*) > 1
        UNION ALL
        SELECT 'shares', 'owner_id,viewer_id', concat_ws('|', owner_id, viewer_id), count(*)
        FROM share_edits GROUP BY ALL HAVING count(*) > 1
        UNION ALL
        SELECT 'activities', 'activity_id', activity_id, count(*) FROM edits GROUP BY ALL HAVING count(*) > 1
        UNION ALL
        SELECT 'goals', 'goal_id', CAST(owner_id * 2 AS VARCHAR), count(*) FROM goal_texts
        GROUP BY ALL HAVING count(*) > 1
        UNION ALL
        SELECT 'profiles', 'email', email, count(*) FROM profiles GROUP BY ALL HAVING count(*) > 1""",
    "signup_profiles": """
        SELECT *, lower(username) || '@example.org' AS login FROM (
            SELECT owner_id, email,
                   CASE WHEN owner_id % 2 = 0 THEN 'u' || CAST(owner_id AS VARCHAR)
                        ELSE split_part(email, '@', 1) END AS username,
                   CASE WHEN owner_id % 2 = 0 THEN 'u' || CAST(owner_id AS VARCHAR)
                        ELSE split_part(email, '@', 1) END AS display_name
            FROM profiles)""",
    "profile_backfill": """
        SELECT owner_id, split_part(email, '@', 1) AS username,
               coalesce(display_name, split_part(email, '@', 1)) AS display_name,
               coalesce(display_name, split_part(email, '@', 1)) AS label FROM profiles""",
    "share_codes": f"""
        WITH first AS (SELECT owner_id, {_digest_code('owner_id', 0)} AS code FROM profiles),
        held AS (SELECT owner_id, code,
                        owner_id = min(owner_id) OVER (PARTITION BY code) AS wins FROM first)
        SELECT owner_id, CASE WHEN wins THEN code ELSE {_digest_code('owner_id', 1)} END AS share_code
        FROM held""",
    "stream_logs": "SELECT * FROM folded",
    "stream_log_state": "SELECT * FROM folded",
    "stream_tally_changes": "SELECT * FROM stream_tallies",
    "stream_day_tally": "SELECT * FROM stream_tallies",
    "stream_windowed_weeks": f"""
        SELECT owner_id, {_week('ts')} AS week_start, CAST(count(*) AS BIGINT) AS edits FROM edits GROUP BY ALL""",
    "stream_week_edits": f"""
        SELECT owner_id, {_week('ts')} AS week_start, count(*) AS edits FROM edits GROUP BY ALL""",
}
_STATEMENTS["day_detail"] = f"SELECT * FROM ({_STATEMENTS['_detail']}) WHERE d IN (SELECT d FROM january)"
_STATEMENTS["today_list"] = f"SELECT * FROM ({_STATEMENTS.pop('_detail')}) WHERE d = {_AS_OF}"


def _needed(sql: str) -> list[str]:
    """Pieces a text mentions, with theirs, in the order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in _PIECES:
            if name not in found and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                found.add(name)
                todo.append(_PIECES[name])
    return [name for name in _PIECES if name in found]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in _STATEMENTS.items():
        pieces = ", ".join(f"{p} AS ({_PIECES[p]})" for p in _needed(sql))
        body = re.sub(r"^\s*WITH ", ", ", sql) if pieces else sql
        out[name] = f"WITH {pieces} {body}" if pieces else body
    return out
