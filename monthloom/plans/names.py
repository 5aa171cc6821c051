"""Series names, labels and dates that the reports go by.

They are the names under which the catalog files its series, spelt as the
catalog spells them, and the labels the reports show.
"""

# --- dates -----------------------------------------------------------------

INDUSTRIAL_EPOCH = "2005-01-01"
PRICE_EPOCH = "1995-01-01"
EMPLOYMENT_EPOCH = "1990-12-31"
RECENT_EPOCH = "2012-01-01"
RECENT_CORRELATION_EPOCH = "2016-01-01"
CPI_BASE_MONTH = "2016-01-31"

# --- panel -----------------------------------------------------------------

CPI = "cpi_all"
INFLATION = "inflation_rate"
SUFFIX_WITHOUT_TOTAL = "_gasprice"
PANEL_ALIASES = {"u.s._gasprice": "us_gasprice"}

# --- industrial report -----------------------------------------------------

INDUSTRIAL_PLAIN = (
    "cpi_all",
    "inflation_rate",
    "manufact_employee",
    "housing_under_construction",
    "neast_housing_under_construction",
    "west_housing_under_construction",
    "south_housing_under_construction",
    "mwest_housing_under_construction",
)

ORDERS_TOTAL = "total_manufact_orders"
ORDERS_LABELS = {
    "durable_manufact_orders": "Durable Goods",
    "machinery_manufact_orders": "Machinery",
    "consumer_goods_manufact_orders": "Consumer Goods",
    "vehicle_manufact_orders": "Vehicles",
    "construction_materials_manufact_orders": "Construction Materials",
    "computer_manufact_orders": "Computers",
    "furnature_manufact_orders": "Furnature",
    "capital_manufact_orders": "Captial Goods",
    "transport_manufact_orders": "Transportation Goods",
    "it_manufact_orders": "IT",
}

TRANSPORT_OUTPUT = "transport_output"
OUTPUT_TOTAL = "all_output"
OUTPUT_LABELS = {
    "manufact_output": "Manufacturing",
    "construction_output": "Construction",
    "buisness_service_output": "Buisness Service",
    "retail_output": "Retail",
    "agriculture_output": "Agriculture",
    "finance_output": "Finance",
    "mining_output": "Mining",
    "it_output": "IT",
    "utilities_output": "Utilities",
    "gov_output": "Government",
    "other_output": "Other",
}

HOUSING_TOTAL = "housing_under_construction"
HOUSING_LABELS = {
    "housing_under_construction": "Total",
    "neast_housing_under_construction": "North East",
    "west_housing_under_construction": "West",
    "south_housing_under_construction": "South",
    "mwest_housing_under_construction": "Midwest",
}

PRICE_ADJUSTED = (ORDERS_TOTAL, *ORDERS_LABELS, TRANSPORT_OUTPUT, OUTPUT_TOTAL, *OUTPUT_LABELS)

INDUSTRIAL_LEVEL_VARIABLES = {
    "cpi_all": "cpi",
    "inflation_rate": "inflation rate",
    "manufact_employee": "manufacturing employees",
    "housing_under_construction": "housing construction",
    "total_manufact_orders": "manufacturing orders",
    "all_output": "industry output",
}
INDUSTRIAL_CHANGE_VARIABLES = {
    "manufact_employee": "employee % change",
    "housing_under_construction": "housing % change",
    "total_manufact_orders": "manufacturing % change",
    "all_output": "output % change",
}

# --- oil report ------------------------------------------------------------

OIL_REGIONS = {
    "padd1_crude_oil_prod": "PADD 1",
    "padd2_crude_oil_prod": "PADD 2",
    "padd3_crude_oil_prod": "PADD 3",
    "padd4_crude_oil_prod": "PADD 4",
    "padd5_crude_oil_prod": "PADD 5",
}
OIL_TOTAL = "total_crude_oil_prod"
OIL_SERIES = (
    OIL_TOTAL,
    *OIL_REGIONS,
    "oil_employees",
    "oil_price",
    "us_gasprice",
    "inflation_rate",
    "cpi_all",
    "total_crude_oil_import",
    "total_crude_oil_export",
)
OIL_FIGURES = {
    "production": "total_crude_oil_prod",
    "employees": "oil_employees",
    "price": "oil_price",
    "imports": "total_crude_oil_import",
    "exports": "total_crude_oil_export",
}
OIL_LEVEL_VARIABLES = {
    "total_crude_oil_prod": "oil production",
    "oil_employees": "employees",
    "total_crude_oil_import": "imports",
    "total_crude_oil_export": "exports",
    "oil_price": "price",
    "us_gasprice": "gas price",
    "cpi_all": "cpi",
    "inflation_rate": "inflation rate",
}
OIL_CHANGE_VARIABLES = {
    "total_crude_oil_prod": "prodction YoY",
    "oil_employees": "employees YoY",
}

# --- price report ----------------------------------------------------------

CPI_SERIES = (
    "cpi_all",
    "cpi_energy",
    "cpi_food",
    "cpi_used_car",
    "cpi_shelter",
    "cpi_new_car",
    "cpi_airfare",
    "cpi_transport",
    "cpi_services",
)
PRICE_SERIES = (
    "egg_price",
    "oj_price",
    "bread_price",
    "ground_beef_price",
    "tomato_price",
    "strawberry_price",
    "coffee_price",
    "bananas_price",
    "us_gasprice",
    "oil_price",
)
PRICES_IN_CENTS = ("coffee_price",)
PRICE_FIGURES = (
    "egg_price",
    "oj_price",
    "bread_price",
    "ground_beef_price",
    "coffee_price",
    "bananas_price",
    "tomato_price",
    "strawberry_price",
)
CPI_FIGURES = (
    "cpi_energy",
    "cpi_food",
    "cpi_used_car",
    "cpi_new_car",
    "cpi_shelter",
    "cpi_services",
    "cpi_airfare",
    "cpi_transport",
)
PRICE_VARIABLES = {
    "inflation_rate": "inflation rate",
    "cpi_all": "overall cpi",
    "cpi_food": "food cpi",
    "cpi_energy": "energy cpi",
    "cpi_shelter": "shelter cpi",
    "cpi_services": "services cpi",
    "cpi_transport": "transport cpi",
    "tomato_price": "tomato price",
    "strawberry_price": "strawberry price",
    "bananas_price": "banana price",
    "coffee_price": "coffee price",
    "egg_price": "egg price",
    "oj_price": "oj price",
    "us_gasprice": "gas price",
    "oil_price": "oil price",
}

# --- fuel report -----------------------------------------------------------

FUEL_NATIONAL = "us_gasprice"
FUEL_REGIONS = {
    "PADD 1a": "padd1a_gasprice",
    "PADD 1b": "padd1b_gasprice",
    "PADD 1c": "padd1c_gasprice",
    "PADD 2": "padd2_gasprice",
    "PADD 3": "padd3_gasprice",
    "PADD 4": "padd4_gasprice",
    "PADD 5": "padd5_gasprice",
}
FUEL_REGION_STATES = {
    "PADD 1a": ("CT", "ME", "MA", "NH", "RI", "VT"),
    "PADD 1b": ("DE", "MD", "NJ", "NY", "PA"),
    "PADD 1c": ("FL", "GA", "NC", "SC", "VA", "WV"),
    "PADD 2": ("OK", "IL", "IN", "IA", "KS", "KY", "MI", "MN", "MO", "NE", "ND", "OH", "SD", "TN", "WI"),
    "PADD 3": ("AL", "AR", "LA", "MS", "NM", "TX"),
    "PADD 4": ("CO", "ID", "MT", "UT", "WY"),
    "PADD 5": ("AK", "AZ", "CA", "HI", "NV", "OR", "WA"),
}
FUEL_SERIES = (*FUEL_REGIONS.values(), FUEL_NATIONAL)

# --- employment report -----------------------------------------------------

EMPLOYEE_SERIES = (
    "manufact_employee",
    "all_employees",
    "job_opening",
    "layoffs",
    "agriculture_employees",
    "mining_employees",
    "wholesale_employees",
    "truck_employees",
    "it_employees",
    "retail_employees",
    "leisure_employees",
    "finance_employees",
    "construction_employees",
    "federal_employees",
    "buisness_employees",
    "health_employees",
    "other_employees",
)
LABOUR_RATE_SERIES = (
    "unemployment",
    "participation_rate",
    "participation_25_54_rate",
    "participation_55+_rate",
    "participation_16_19_rate",
    "participation_20_24_rate",
    "participation_women_rate",
    "participation_men_rate",
    "participation_immigrant_rate",
)
EMPLOYMENT_VARIABLES = {
    "all_employees": "All Emp",
    "job_opening": "Job Openings",
    "layoffs": "Layoffs",
    "unemployment": "Unemployment",
    "participation_rate": "total partrate",
    "participation_16_19_rate": "16-19 partrate",
    "participation_20_24_rate": "20-24 partrate",
    "participation_25_54_rate": "25-55 partrate",
    "participation_55+_rate": "55+ partrate",
    "truck_employees": "Truck Emp",
    "it_employees": "IT Emp",
    "wholesale_employees": "Wholesale Emp",
    "finance_employees": "Finance Emp",
    "health_employees": "Health Emp",
    "federal_employees": "Gov Emp",
}

# --- correlation report ----------------------------------------------------

TICKER_LABELS = {
    "^GSPC": "SP500",
    "^RUT": "Rut2000",
    "GC=F": "Gold",
    "DX-Y.NYB": "DXY",
    "USDCNY=X": "CHY",
    "EURUSD=X": "Euro",
    "BTC-USD": "Bitcoin",
}
MACRO_VARIABLES = {
    "gdp": "GDP",
    "cpi_all": "CPI All",
    "cpi_energy": "CPI Energy",
    "cpi_food": "CPI Food",
    "cpi_shelter": "CPI Shelter",
    "cpi_airfare": "CPI Airfare",
    "cpi_transport": "CPI Transport",
    "cpi_services": "CPI Services",
    "us_gasprice": "Gas Price",
    "egg_price": "Egg Price",
    "bananas_price": "Banana Price",
    "oil_price": "Oil Price",
    "electricity_price": "Electricity Price",
    "oj_price": "OJ Price",
    "bread_price": "Bread Price",
    "ground_beef_price": "Beef Price",
    "tomato_price": "Tomato Price",
    "strawberry_price": "Strawberry Price",
    "coffee_price": "Coffee Price",
    "all_construction_spend": "Construction Spend",
    "housing_under_construction": "Housing Build",
    "total_manufact_orders": "Manufacturing Orders",
    "durable_manufact_orders": "Durable Orders",
    "machinery_manufact_orders": "Machinery Orders",
    "consumer_goods_manufact_orders": "Goods Orders",
    "vehicle_manufact_orders": "Vehicle Orders",
    "construction_materials_manufact_orders": "Construction Materials",
    "population": "Population",
    "federal_outlays": "Federal Spending",
    "all_imports": "Imports",
    "all_exports": "Exports",
    "unemployment": "Unemployment",
    "computer_manufact_orders": "Computer Orders",
    "furnature_manufact_orders": "Furniture Orders",
    "capital_manufact_orders": "Capital Orders",
    "transport_manufact_orders": "Transport Orders",
    "it_manufact_orders": "IT Orders",
    "neast_housing_under_construction": "Northeast Housing",
    "west_housing_under_construction": "West Housing",
    "south_housing_under_construction": "South Housing",
    "mwest_housing_under_construction": "Midwest Housing",
    "job_opening": "Job Openings",
    "layoffs": "Layoffs",
    "all_employees": "Total Employees",
    "manufact_employee": "Manufacturing Jobs",
    "oil_employees": "Oil Jobs",
    "federal_employees": "Federal Jobs",
    "health_employees": "Health Jobs",
    "buisness_employees": "Business Jobs",
    "agriculture_employees": "Agriculture Jobs",
    "mining_employees": "Mining Jobs",
    "wholesale_employees": "Wholesale Jobs",
    "truck_employees": "Truck Jobs",
    "it_employees": "IT Jobs",
    "retail_employees": "Retail Jobs",
    "leisure_employees": "Leisure Jobs",
    "finance_employees": "Finance Jobs",
    "construction_employees": "Construction Jobs",
    "participation_rate": "Participation Rate",
    "participation_25_54_rate": "Participation Rate (24-55)",
    "participation_55+_rate": "Participation Rate (55+)",
    "participation_women_rate": "Participation Rate (Women)",
    "participation_men_rate": "Participation Rate (Men)",
    "participation_immigrant_rate": "Participation Rate (Immigrant)",
    "us_natural_gas_prod": "Natural Gas Output",
    "total_crude_oil_prod": "Crude Oil Output",
    "total_crude_oil_import": "Crude Oil Import",
    "total_crude_oil_export": "Crude Oil Export",
    "total_million_tons_co2": "CO2 Emissions",
}

# --- recent developments ---------------------------------------------------

CORE_VARIABLES = {
    "cpi_all": "cpi",
    "inflation_rate": "inflation",
    "all_construction_spend": "construction spend",
    "housing_under_construction": "housing construction",
    "egg_price": "egg price",
    "total_manufact_orders": "manufacturing orders",
    "population": "population",
    "federal_outlays": "federal spending",
    "federal_employees": "govt employees",
    "gas_price": "gas price",
    "oil_price": "oil price",
    "industrial_prod": "industrial prod",
    "electricity_price": "electricity price",
    "all_imports": "imports",
    "all_exports": "exports",
    "us_natural_gas_prod": "natgas prod",
    "total_crude_oil_prod": "oil prod",
    "total_crude_oil_export": "oil export",
    "total_crude_oil_import": "oil import",
    "total_million_tons_co2": "co2 emission",
}
SPENDING_AND_STAFF = ("federal_outlays", "federal_employees")
OIL_PRODUCTION_LINES = (OIL_TOTAL, *OIL_REGIONS, "oil_employees")
OIL_EXPORT_LINES = (
    "total_crude_oil_export",
    "padd1_crude_oil_export",
    "padd2_crude_oil_export",
    "padd3_crude_oil_export",
    "padd4_crude_oil_export",
    "padd5_crude_oil_export",
    "oil_employees",
)
RECENT_MONTHS = 37
COLOUR_SCALE_LOW = -6.0
