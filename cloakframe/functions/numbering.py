"""Telephone numbers of the Union's countries by numbering plan: region, national number, line type and validity.

A number in international form is read by the longest prefix that a plan knows: first the calling code, which no other
begins with, then the digits behind it, of which the longest known beginning gives the line type and how many digits are
due. The plans are public facts of national numbering plans; beginnings that a plan does not list have its general rule.
"""

from __future__ import annotations

from .sqltext import digits, let, lit

# Calling codes, and per country the beginnings of national numbers as "beginnings:type:digits", the first
# entry, without beginnings, being the general rule.
CALLING = dict(AT=43, BE=32, BG=359, HR=385, CY=357, CZ=420, DK=45, EE=372, FI=358, FR=33, DE=49, GR=30, HU=36, IE=353, IT=39, LV=371, LT=370, LU=352, MT=356, NL=31, PL=48, PT=351, RO=40, SK=421, SI=386, ES=34, SE=46)
PLANS = dict(
    AT=":fixed_line:5-13 650,660,664,676,680,681,688,699:mobile:9-13 800:toll_free:9-13 810,820:shared_cost:9-13 900,930:premium_rate:9-13 720:voip:9-13",
    BE=":fixed_line:8-8 45,46,47,48,49:mobile:9-9 800:toll_free:8-8 78:shared_cost:8-8 90:premium_rate:8-8",
    BG=":fixed_line:7-8 87,88,89,98:mobile:8-9 800:toll_free:8-8 700:shared_cost:8-8 90:premium_rate:8-8",
    HR=":fixed_line:8-8 91,92,95,97,98,99:mobile:8-9 800:toll_free:7-9 60:premium_rate:6-8 62:shared_cost:6-8",
    CY="2:fixed_line:8-8 94,95,96,97,99:mobile:8-8 800:toll_free:8-8 90:premium_rate:8-8 70:personal:8-8",
    CZ="2,3,4,5:fixed_line:9-9 601,602,603,604,605,606,607,608,70,72,73,77,79:mobile:9-9 800:toll_free:9-9 90:premium_rate:9-9 910:voip:9-9",
    DK=":fixed_or_mobile:8-8 80:toll_free:8-8 90:premium_rate:8-8",
    EE="3,4,6,7:fixed_line:7-7 5,81,82:mobile:7-8 800:toll_free:7-10 900:premium_rate:7-7",
    FI=":fixed_line:5-9 40,41,42,43,44,45,46,50:mobile:6-10 800:toll_free:7-9 600,700:premium_rate:8-9",
    FR="1,2,3,4,5:fixed_line:9-9 6,7:mobile:9-9 80:toll_free:9-9 81,82:shared_cost:9-9 89:premium_rate:9-9 9:voip:9-9",
    DE=":fixed_line:5-11 15,16,17:mobile:10-11 800:toll_free:10-10 180:shared_cost:7-11 900:premium_rate:10-10 700:personal:11-11 32:voip:9-11",
    GR="2:fixed_line:10-10 69:mobile:10-10 800:toll_free:10-10 801:shared_cost:10-10 90:premium_rate:10-10 70:personal:10-10",
    HU=":fixed_line:8-8 20,30,31,50,70:mobile:9-9 80:toll_free:8-8 90,91:premium_rate:8-8 21:voip:9-9 40:shared_cost:8-8",
    IE=":fixed_line:7-9 83,85,86,87,88,89:mobile:9-9 1800:toll_free:10-10 1850,1890:shared_cost:10-10 15:premium_rate:10-10 76:voip:9-9",
    IT="0:fixed_line:6-11 3:mobile:9-10 800,803:toll_free:6-9 84:shared_cost:6-9 89:premium_rate:6-10 55:voip:10-10",
    LV="6:fixed_line:8-8 2:mobile:8-8 80:toll_free:8-8 90:premium_rate:8-8 81:shared_cost:8-8",
    LT="3,4,5:fixed_line:8-8 6:mobile:8-8 800:toll_free:8-8 808:shared_cost:8-8 90:premium_rate:8-8 700:personal:8-8",
    LU=":fixed_line:4-11 621,628,661,668,671,678,691,698:mobile:9-9 800:toll_free:8-8 801:shared_cost:8-8 90:premium_rate:8-8 20:voip:6-10",
    MT="2:fixed_line:8-8 7,9:mobile:8-8 800:toll_free:8-8 50:premium_rate:8-8",
    NL="1,2,3,4,5,7:fixed_line:9-9 61,62,63,64,65,68:mobile:9-9 800:toll_free:7-10 90:premium_rate:7-10 85,91:voip:9-9 88:uan:9-9",
    PL=":fixed_line:9-9 45,50,51,53,57,60,66,69,72,73,78,79,88:mobile:9-9 800:toll_free:9-9 801:shared_cost:9-9 70:premium_rate:9-9 39:voip:9-9",
    PT="2:fixed_line:9-9 91,92,93,96:mobile:9-9 800:toll_free:9-9 808:shared_cost:9-9 760:premium_rate:9-9 30:voip:9-9",
    RO="2,3:fixed_line:9-9 7:mobile:9-9 800:toll_free:9-9 801:shared_cost:9-9 90:premium_rate:9-9",
    SK="2,3,4,5:fixed_line:9-9 90,91,94,95:mobile:9-9 800:toll_free:9-9 85:shared_cost:9-9 900:premium_rate:9-9 69:voip:9-9",
    SI="1,2,3,4,5,7:fixed_line:8-8 30,31,40,41,51,64,65,68,69,70,71:mobile:8-8 80:toll_free:6-8 90:premium_rate:5-8 59:voip:8-8",
    ES="81,82,83,84,85,86,87,88,91,92,93,94,95,96,97,98:fixed_line:9-9 6,71,72,73,74,75,76,77,78,79:mobile:9-9 800,900:toll_free:9-9 901,902:shared_cost:9-9 803,806,807,905:premium_rate:9-9 70:personal:9-9",
    SE=":fixed_line:7-9 70,72,73,76,79:mobile:9-9 20:toll_free:6-9 77:shared_cost:6-9 900,939,944:premium_rate:7-10",
)


def plan_rows() -> list[tuple[str, str, str, int, int]]:
    """(prefix with calling code, region, line type, least digits, most digits) of all plans."""
    out = []
    for region, plan in PLANS.items():
        for entry in plan.split(" "):
            beginnings, kind, sizes = entry.split(":")
            least, most = map(int, sizes.split("-"))
            out += [(f"{CALLING[region]}{b}", region, kind, least, most) for b in beginnings.split(",")]
    return out


def _entry(full: str) -> str:
    """The plan entry of the longest known prefix of digits, or null: one map of prefixes for each length."""
    by_length: dict[int, list[str]] = {}
    for prefix, region, kind, least, most in plan_rows():
        by_length.setdefault(len(prefix), []).append(f"{lit(prefix)}, named_struct('region', {lit(region)}, 'kind', {lit(kind)}, 'least', {least}, 'most', {most})")
    found = [f"try_element_at(map({', '.join(rows)}), left({full}, {n}))" for n, rows in sorted(by_length.items(), reverse=True)]
    return f"coalesce({', '.join(found)})"


def number(s: str) -> str:
    """SQL of (region, national, line_type, valid) of a number in international form, with + or 00; a zero in brackets behind the calling code is left out. Null where it begins with no calling code of the plans."""
    bare = f"regexp_replace({s}, '\\\\(0\\\\)', '')"
    full = f"if(ltrim({bare}) like '+%', {digits(bare)}, if(ltrim({bare}) like '00%', substring({digits(bare)}, 3), null))"
    codes = "map(" + ", ".join(f"{lit(r)}, {len(str(c))}" for r, c in CALLING.items()) + ")"

    def known(d: str) -> str:
        # A number that has a calling code but no entry of the plan is none of its kinds.
        region = "case " + " ".join(f"when {d} like '{c}%' then '{r}'" for r, c in CALLING.items()) + " end"

        def of(e: str) -> str:
            where = f"coalesce({e}.region, {region})"
            rest = f"substring({d}, {codes}[{where}] + 1)"
            return f"if({where} is null, null, named_struct('region', {where}, 'national', {rest}, 'line_type', coalesce({e}.kind, 'unknown'), 'valid', coalesce(length({rest}) between {e}.least and {e}.most, false)))"

        return let(_entry(d), of)

    return let(full, known)


def valid(s: str) -> str:
    """Whether a number's plan knows its beginning and has numbers of its length."""
    return f"coalesce({number(s)}.valid, false)"
