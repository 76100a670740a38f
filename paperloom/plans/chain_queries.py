"""The page chain over packets and mixed pages, and its SQL from the same fixed patterns."""

from __future__ import annotations

from ..operators import pagechain, segment
from .catalog_queries import _MIXED, _mixed_pages, _q, start_sql
from .corpus import PACKETS_SQL


def mixed_starts(spark, sf_dir):
    """Starts by the chain where mails, forms, sheets and bare pages follow each other."""
    return pagechain.page_starts(_mixed_pages(spark, sf_dir))


QUERIES = {"mixed_starts": mixed_starts}


def _has(text: str, *patterns: str) -> str:
    return f"regexp_matches({text}, '(?im){_q('|'.join(f'(?:{p})' for p in patterns))}')"


def _group(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '(?i){_q(pattern)}', {group}), '')"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


_SUBJECT = _strip(rf"regexp_replace({_strip(_group('t', r'Subject:\s*(.+)'))}, '(?i)^(RE:|FW:|FWD:)\s*', '')")
_VENDOR = "CASE " + " ".join(f"WHEN contains(upper(t), '{w}') THEN '{n}'" for w, n in pagechain.VENDORS) + f" ELSE {_strip(_group('t[1:500]', r'(From|Vendor|Supplier):\s*([^\n]+)', 2))} END"
_OPENS = f"regexp_matches({_strip('t')}, '(?i)\\A(?:{_q('|'.join(pagechain.OPENINGS))})')"
_FORM = "(" + " + ".join(f"{_has('t[1:1000]', p)}::INT" for p in pagechain.FORM_SIGNS) + " >= 2)"
_BASE = f"""(length({_strip('t')}) >= 20 AND ({_has('t[1:800]', *pagechain.EMAIL_SIGNS)} OR ({_has('t[1:400]', *pagechain.BASIC_SIGNS)} AND (page_num = 0 OR {_OPENS})) OR {start_sql('t', 'page_num')}
  OR {_has('t[1:1500]', *pagechain.START_PATTERNS)} OR regexp_matches(t[1:1500], '{segment.DRAWING_NUMBER}') OR {_FORM}))"""
_FACTS = {
    "n": "length(t)", "quoted": r"len(regexp_extract_all(t, '(?m)^>+\s*')) > len(string_split(t, chr(10))) * 0.3", "subject": _SUBJECT, "mail": _has("t", "From:|To:|Subject:"),
    "header": f"({_has('t[1:1000]', pagechain.EMAIL_HEADER)} AND instr(lower(t), 'from:') <= 51 AND NOT {_has('t[1:500]', pagechain.QUOTED_MAIL)})",
    "slip": "contains(upper(t), 'PACKING SLIP')", "slip_head": "contains(upper(t[1:200]), 'PACKING SLIP')", "vendor": _VENDOR, "ordered": "coalesce(" + ", ".join(_group("t[1:1000]", p) for p in pagechain.ORDER_NUMBERS) + ")",
    "drawing": _has("t[1:500]", pagechain.SHEET), "sheet": f"try_cast({_group('t[1:500]', r'SHEET\s*(\d+)')} AS BIGINT)", "section": _has("t[1:500]", pagechain.SECTION),
    "rfi": _group("t[1:500]", r"RFI[:\s#-]*(\d+)"), "rfi_head": _has("t[1:1000]", r"REQUEST\s+FOR\s+INFORMATION.*RFI[:\s#-]*\d+"),
    "submittal": _has("t[1:500]", "SUBMITTAL"), "submittal_no": _group("t[1:500]", r"SUBMITTAL.*?(\d+)"), "submittal_head": _has("t[1:500]", r"SUBMITTAL\s*(TRANSMITTAL|#|NUMBER)?[:\s]*\d+"), "shop": _has("t[1:500]", r"SHOP\s+DRAWING.*SUBMITTAL"),
    "payment": _has("t[1:500]", pagechain.PAYMENT_LIKE), "g703": _has("t[1:500]", r"Document\s+G703.*Continuation\s+Sheet"), "vals": _has("t[1:500]", r"SCHEDULE\s+OF\s+VALUES"), "more": _has("t[1:500]", r"Application\s+No|Period\s+To|ITEM\s+SCHEDULED"),
    "invoice": _has("t[1:500]", pagechain.INVOICE_LIKE), "invoice_no": _group("t[1:500]", r"Invoice\s*#?\s*:?\s*(\d+)"), "cost": _has("t[1:500]", r"COST\s+PROPOSAL\s*#?\s*\d+"),
    "running": f"(length({_strip('t')}) < 100 AND regexp_matches({_strip('t')}, '(?i){pagechain.RUNNING_LINE.replace(chr(92) + 'Z', chr(92) + 'z')}'))", "base": _BASE,
}


def chain_sql(pages: str) -> str:
    """pdf_id, page_num, is_start of a table of pages, as SQL."""
    before = ", ".join(f"CASE WHEN page_num > 1 THEN lag({k}) OVER o END AS p_{k}" for k in _FACTS)
    return f"""f AS (SELECT pdf_id, page_num, {', '.join(f'{v} AS {k}' for k, v in _FACTS.items())} FROM (SELECT *, coalesce(text, '') AS t FROM {pages})),
b AS (SELECT *, {before} FROM f WINDOW o AS (PARTITION BY pdf_id ORDER BY page_num)),
v AS (
  SELECT *, coalesce(p_n > 0, false) AS had_text, coalesce(sheet = p_sheet + 1, false) AS next_sheet,
    coalesce(p_submittal, false) AND (shop OR (submittal AND coalesce(submittal_no = p_submittal_no, false))) AS submittal_on FROM b),
w AS (
  SELECT *,
    coalesce(quoted, false) OR coalesce(subject = p_subject, false) OR (coalesce(p_slip, false) AND slip_head AND coalesce(vendor = p_vendor, false) AND coalesce(ordered = p_ordered, false)) OR (coalesce(p_drawing, false) AND drawing AND next_sheet) AS goes_on,
    header AND NOT (had_text AND n < 300 AND coalesce(p_mail, false)) AND NOT (had_text AND p_subject IS NOT NULL AND subject IS NULL) AS new_mail,
    had_text AND (g703 OR (coalesce(p_payment, false) AND (vals OR more))) AS payment_on,
    (had_text AND invoice AND (coalesce(invoice_no != p_invoice_no, false) OR NOT coalesce(p_invoice, false)))
      OR (slip_head AND (NOT had_text OR coalesce(vendor != p_vendor, false) OR coalesce(ordered != p_ordered, false) OR NOT coalesce(p_slip, false))) OR cost
      OR (had_text AND section AND (NOT coalesce(p_drawing, false) OR coalesce(sheet != p_sheet + 1, false))) OR vals AS new_part FROM v)
SELECT pdf_id, page_num, page_num = 0 OR CASE WHEN goes_on THEN false WHEN new_mail THEN true WHEN rfi_head AND NOT coalesce(rfi = p_rfi, false) THEN true WHEN submittal_head AND NOT submittal_on THEN true
  WHEN payment_on THEN false WHEN new_part THEN true ELSE base AND NOT running END AS is_start FROM w"""


ORACLE_SQL = {"chained_starts": f"WITH {PACKETS_SQL}, {chain_sql('packets')}", "mixed_starts": f"WITH {_MIXED}, {chain_sql('mixed')}"}
