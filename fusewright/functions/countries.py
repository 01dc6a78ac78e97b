"""Countries by their two-letter codes: names, and a point for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by code.
NAMES = {
    "AF": "Afghanistan", "AL": "Albania", "DZ": "Algeria", "AO": "Angola", "AR": "Argentina", "AM": "Armenia", "AU": "Australia", "AT": "Austria", "AZ": "Azerbaijan",
    "BH": "Bahrain", "BD": "Bangladesh", "BY": "Belarus", "BE": "Belgium", "BR": "Brazil", "BG": "Bulgaria", "MM": "Myanmar", "KH": "Cambodia", "CM": "Cameroon",
    "CA": "Canada", "CF": "Central African Republic", "TD": "Chad", "CL": "Chile", "CN": "China", "CO": "Colombia", "CD": "DR Congo", "CG": "Congo", "HR": "Croatia",
    "CU": "Cuba", "CY": "Cyprus", "CZ": "Czechia", "DK": "Denmark", "DJ": "Djibouti", "EC": "Ecuador", "EG": "Egypt", "SV": "El Salvador", "ER": "Eritrea", "EE": "Estonia",
    "ET": "Ethiopia", "FI": "Finland", "FR": "France", "GE": "Georgia", "DE": "Germany", "GH": "Ghana", "GR": "Greece", "GT": "Guatemala", "GN": "Guinea", "HT": "Haiti",
    "HN": "Honduras", "HK": "Hong Kong", "HU": "Hungary", "IS": "Iceland", "IN": "India", "ID": "Indonesia", "IR": "Iran", "IQ": "Iraq", "IE": "Ireland", "IL": "Israel",
    "IT": "Italy", "JP": "Japan", "JO": "Jordan", "KZ": "Kazakhstan", "KE": "Kenya", "KP": "North Korea", "KR": "South Korea", "KW": "Kuwait", "KG": "Kyrgyzstan", "LA": "Laos",
    "LV": "Latvia", "LB": "Lebanon", "LY": "Libya", "LT": "Lithuania", "MG": "Madagascar", "MY": "Malaysia", "ML": "Mali", "MX": "Mexico", "MD": "Moldova", "MN": "Mongolia",
    "ME": "Montenegro", "MA": "Morocco", "MZ": "Mozambique", "NA": "Namibia", "NP": "Nepal", "NL": "Netherlands", "NZ": "New Zealand", "NI": "Nicaragua", "NE": "Niger",
    "NG": "Nigeria", "NO": "Norway", "OM": "Oman", "PK": "Pakistan", "PS": "Palestine", "PA": "Panama", "PG": "Papua New Guinea", "PY": "Paraguay", "PE": "Peru",
    "PH": "Philippines", "PL": "Poland", "PT": "Portugal", "QA": "Qatar", "RO": "Romania", "RU": "Russia", "RW": "Rwanda", "SA": "Saudi Arabia", "SN": "Senegal",
    "RS": "Serbia", "SG": "Singapore", "SK": "Slovakia", "SI": "Slovenia", "SO": "Somalia", "ZA": "South Africa", "SS": "South Sudan", "ES": "Spain", "LK": "Sri Lanka",
    "SD": "Sudan", "SE": "Sweden", "CH": "Switzerland", "SY": "Syria", "TW": "Taiwan", "TJ": "Tajikistan", "TZ": "Tanzania", "TH": "Thailand", "TN": "Tunisia", "TR": "Turkey",
    "TM": "Turkmenistan", "UG": "Uganda", "UA": "Ukraine", "AE": "UAE", "GB": "UK", "US": "United States", "UY": "Uruguay", "UZ": "Uzbekistan", "VE": "Venezuela",
    "VN": "Vietnam", "YE": "Yemen", "ZM": "Zambia", "ZW": "Zimbabwe",
}
#: Points by code.
CENTERS = {
    "GB": (54.0, -2.0), "UK": (54.0, -2.0), "US": (39.0, -98.0), "UA": (48.5, 31.2), "RU": (56.0, 38.0), "IL": (31.5, 34.8), "PS": (31.9, 35.2), "SY": (35.0, 38.0),
    "IR": (32.4, 53.7), "IQ": (33.0, 44.0), "LB": (33.9, 35.8), "YE": (15.6, 48.5), "SA": (24.7, 45.1), "TR": (39.0, 35.2), "EG": (26.8, 30.8), "SD": (15.5, 32.5),
    "SO": (5.0, 46.0), "ET": (9.0, 38.7), "LY": (27.0, 17.0), "CN": (35.0, 105.0), "TW": (23.7, 121.0), "KR": (36.5, 128.0), "KP": (40.0, 127.0), "JP": (36.2, 138.3),
    "MM": (19.8, 96.0), "PH": (12.9, 121.8), "CD": (-4.0, 21.8), "ML": (17.6, -4.0), "NE": (17.6, 8.1), "BF": (12.4, -1.6), "NG": (9.1, 7.5), "DE": (51.2, 10.5),
    "FR": (46.6, 2.2), "PL": (52.0, 19.0), "NO": (60.5, 8.5), "SE": (62.0, 15.0), "FI": (64.0, 26.0), "IN": (20.6, 78.9), "PK": (30.4, 69.3), "AF": (33.9, 67.7),
    "HT": (19.0, -72.4), "BD": (23.7, 90.4), "MZ": (-18.7, 35.5), "SS": (6.9, 31.3), "CF": (6.6, 20.9), "TD": (15.5, 18.7), "CM": (7.4, 12.4), "KE": (0.0, 37.9),
    "UG": (1.4, 32.3), "RW": (-1.9, 29.9), "BI": (-3.4, 29.9), "CO": (4.6, -74.1), "VE": (6.4, -66.6), "NP": (28.4, 84.1), "LK": (7.9, 80.8), "ID": (-0.8, 113.9),
    "MG": (-18.8, 46.9), "MW": (-13.3, 34.3), "ZW": (-20.0, 30.0), "SL": (8.5, -11.8), "LR": (6.4, -9.4), "GN": (9.9, -9.7), "DJ": (11.6, 43.1), "ER": (15.2, 39.8),
    "JO": (31.2, 36.6),
}


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def country_name(code: Column) -> Column:
    """The name of a code, whatever its case; what is none in upper case."""
    return F.coalesce(_lookup(F.upper(code), NAMES), F.upper(code))


def country_center(code: Column) -> tuple[Column, Column]:
    return tuple(_lookup(F.upper(code), {k: v[i] for k, v in CENTERS.items()}) for i in (0, 1))
