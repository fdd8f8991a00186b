"""Places, categories and measures of the social-determinant seed."""

# County -> (fips, name); zip codes per county.
DEFAULT_COUNTY = ("13121", "Fulton County")
COUNTIES = {
    ("13089", "DeKalb County"): ["30032", "30033", "30319", "30322", "30329"],
    ("13067", "Cobb County"): ["30060", "30080", "30082", "30144", "30339"],
    ("13121", "Fulton County"): ["30303", "30305", "30308", "30309", "30310", "30311", "30312", "30313", "30314", "30315", "30316", "30318", "30324", "30326", "30327", "30328", "30331", "30342"],
}
# Id, name, description.
CATEGORIES = [
    (1, "Economic Stability", "Synthetic economic stability indicators"),
    (2, "Health Care Access and Quality", "Synthetic access indicators"),
    (3, "Neighborhood and Built Environment", "Synthetic built-environment indicators"),
]
# Id, name, abbreviation, description.
UNITS = [(1, "US Dollars", "USD", "US dollars"), (2, "Index", "Index", "Synthetic 0-100 score")]
# Category, unit, description, name, base, modulus, factor.
MEASURES = [
    (1, 1, "Median household income", "ACS_MEDIAN_HH_INC", 52000, 34, 1000),
    (1, 2, "Population below poverty", "SAIPE_TOT_POV", 8, 18, 1),
    (2, 2, "Food access research atlas", "FFR16", 45, 41, 1),
    (3, 2, "Non-metro indicator", "Nonmetro2013", 0, 2, 1),
    (3, 2, "Population-weighted arsenic exposure", "NEPHTN_ARSENIC_MEAN_POP", 5, 26, 1),
    (3, 2, "Observed rehospitalization rate", "LTC_AVG_OBS_REHOSP_RATE", 10, 21, 1),
]
SOURCE = "SyntheticSdohSeed"
