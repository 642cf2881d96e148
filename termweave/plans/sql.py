"""Building blocks of the comparison SQL, written for another engine than Spark."""

from __future__ import annotations


def rank(day: str) -> str:
    return f"CASE WHEN month({day}) <= 4 THEN 0 WHEN month({day}) <= 7 THEN 1 ELSE 2 END"


def ord_(day: str) -> str:
    return f"(year({day}) * 3 + {rank(day)})::INTEGER"


def term(day: str) -> str:
    return (
        f"(year({day})::VARCHAR || CASE WHEN month({day}) <= 4 THEN 'SP' "
        f"WHEN month({day}) <= 7 THEN 'SU' ELSE 'FA' END)"
    )


def code(ordinal: str) -> str:
    return f"(({ordinal}) // 3)::VARCHAR || ['SP', 'SU', 'FA'][(({ordinal}) % 3 + 1)::INTEGER]"


def student(key: str) -> str:
    return f"printf('S%06d', {key})"


def moodle(key: str) -> str:
    return f"printf('mdl_s%06d', {key})"


def workday(key: str) -> str:
    return f"printf('WD%08d', {key})"


def fraction(salt: str, key: str) -> str:
    return f"(('0x' || substr(md5('{salt}:' || ({key})::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


CROSSWALK = f"""crosswalk AS (
    SELECT {student('c_custkey')} AS student_id, {moodle('c_custkey')} AS moodle_user_key,
           {workday('c_custkey')} AS workday_person_id
    FROM customer)"""

SIS = f"""sis AS (
    SELECT {student('o_custkey')} AS student_id, {term('o_orderdate')} AS term_code,
           CASE WHEN o_orderstatus = 'P' THEN 'not_enrolled' ELSE 'enrolled' END AS enrollment_status,
           (5 - substr(o_orderpriority, 1, 1)::INTEGER)::DOUBLE AS term_gpa
    FROM orders)"""

LMS = f"""lms AS (
    SELECT {moodle('o_custkey')} AS moodle_user_key, {term('l_shipdate')} AS term_code,
           l_quantity::BIGINT AS login_count
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

AID = f"""aid AS (
    SELECT {workday('o_custkey')} AS workday_person_id, {term('l_shipdate')} AS term_code,
           floor(l_extendedprice)::BIGINT AS loans
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
