"""Fixed domain values.  Results depend on these exact numbers and texts."""

POLLUTANTS = ["pm25", "pm10", "co", "no2", "so2", "o3"]

# Order in which scores are weighed and in which ties for the dominant pollutant are resolved.
SCORED_POLLUTANTS = ["pm25", "pm10", "so2", "no2", "co", "o3"]

# Risk weight and concentration thresholds (good, moderate, poor, severe).
RISK_WEIGHTS = {"pm25": 0.30, "pm10": 0.20, "so2": 0.20, "no2": 0.15, "co": 0.10, "o3": 0.05}
RISK_THRESHOLDS = {
    "pm25": (12.0, 35.0, 55.0, 150.0),
    "pm10": (54.0, 154.0, 254.0, 354.0),
    "so2": (40.0, 80.0, 380.0, 800.0),
    "no2": (40.0, 80.0, 180.0, 280.0),
    "co": (1.0, 2.0, 10.0, 17.0),
    "o3": (50.0, 100.0, 168.0, 208.0),
}

# Weights of the composite training target.
TARGET_WEIGHTS = {"pm25": 0.35, "pm10": 0.20, "no2": 0.15, "so2": 0.10, "co": 0.10, "o3": 0.10}

# Valid concentration range per pollutant.
VALID_RANGES = {
    "pm25": (0.0, 500.0),
    "pm10": (0.0, 600.0),
    "co": (0.0, 50.0),
    "no2": (0.0, 400.0),
    "so2": (0.0, 400.0),
    "o3": (0.0, 300.0),
}

# Looser bounds used by the data-quality report.
QUALITY_RANGES = {
    "pm25": (0.0, 500.0),
    "pm10": (0.0, 600.0),
    "co": (0.0, 50.0),
    "no2": (0.0, 2000.0),
    "so2": (0.0, 2000.0),
}

# Pollution weight of an industry; anything else weighs 6.
INDUSTRY_RISK_WEIGHT = {
    "steel": 9,
    "cement": 8,
    "chemical": 10,
    "textile": 6,
    "automotive": 7,
    "electronics": 4,
    "pharmaceutical": 6,
    "food_processing": 5,
    "general_industry": 6,
    "industrial": 7,
    "works": 6,
    "factory": 7,
}
DEFAULT_INDUSTRY_WEIGHT = 6

HIGH_RISK_INDUSTRIES = ["chemical", "steel", "power", "pharmaceutical", "cement"]
MEDIUM_RISK_INDUSTRIES = ["manufacturing", "automotive", "paper", "food_processing"]

# Spelling variants of an industry label.
INDUSTRY_ALIASES = {
    "food": "food_processing",
    "brewery": "food_processing",
    "dairy": "food_processing",
    "automobile": "automotive",
    "auto": "automotive",
    "vehicle": "automotive",
    "general industry": "general_industry",
    "general_industrial": "general_industry",
    "manufacturing": "works",
}

# Keywords looked up in the joined site tags, first group that matches wins.
INDUSTRY_KEYWORDS = [
    ("steel", ["steel", "metal", "smelting"]),
    ("chemical", ["chemical", "refinery"]),
    ("textile", ["textile", "garment"]),
    ("pharmaceutical", ["pharmaceutical", "medicine"]),
    ("cement", ["cement", "concrete"]),
    ("power", ["power", "energy"]),
    ("food_processing", ["food", "brewery", "dairy"]),
    ("automotive", ["auto", "automobile", "vehicle"]),
    ("paper", ["paper", "pulp"]),
]

# City, state, centre latitude, centre longitude.
CITIES = [
    ("Pune", "Maharashtra", 18.5204, 73.8567),
    ("Mumbai", "Maharashtra", 19.0760, 72.8777),
    ("Nagpur", "Maharashtra", 21.1458, 79.0882),
    ("Nashik", "Maharashtra", 19.9975, 73.7898),
    ("Aurangabad", "Maharashtra", 19.8762, 75.3433),
    ("Surat", "Gujarat", 21.1702, 72.8311),
    ("Ahmedabad", "Gujarat", 23.0225, 72.5714),
    ("Vadodara", "Gujarat", 22.3072, 73.1812),
    ("Rajkot", "Gujarat", 22.3039, 70.8022),
    ("Chennai", "Tamil Nadu", 13.0827, 80.2707),
    ("Coimbatore", "Tamil Nadu", 11.0168, 76.9558),
    ("Madurai", "Tamil Nadu", 9.9252, 78.1198),
    ("Hyderabad", "Telangana", 17.3850, 78.4867),
    ("Visakhapatnam", "Andhra Pradesh", 17.6868, 83.2185),
    ("Bengaluru", "Karnataka", 12.9716, 77.5946),
    ("Mangaluru", "Karnataka", 12.9141, 74.8560),
    ("Delhi", "Delhi", 28.6139, 77.2090),
    ("Noida", "Uttar Pradesh", 28.5355, 77.3910),
    ("Gurgaon", "Haryana", 28.4595, 77.0266),
    ("Faridabad", "Haryana", 28.4089, 77.3178),
    ("Kolkata", "West Bengal", 22.5726, 88.3639),
    ("Howrah", "West Bengal", 22.5958, 88.2636),
    ("Jaipur", "Rajasthan", 26.9124, 75.7873),
    ("Jodhpur", "Rajasthan", 26.2389, 73.0243),
    ("Bhopal", "Madhya Pradesh", 23.2599, 77.4126),
    ("Indore", "Madhya Pradesh", 22.7196, 75.8577),
    ("Lucknow", "Uttar Pradesh", 26.8467, 80.9462),
    ("Kanpur", "Uttar Pradesh", 26.4499, 80.3319),
]

# Centres of the cities readings are collected for.
READING_CITY_CENTRES = [
    ("Delhi", 28.6139, 77.2090),
    ("Mumbai", 19.0760, 72.8777),
    ("Pune", 18.5204, 73.8567),
    ("Bengaluru", 12.9716, 77.5946),
    ("Chennai", 13.0827, 80.2707),
    ("Hyderabad", 17.3850, 78.4867),
    ("Kolkata", 22.5726, 88.3639),
    ("Ahmedabad", 23.0225, 72.5714),
    ("Surat", 21.1702, 72.8311),
    ("Jaipur", 26.9124, 75.7873),
    ("Lucknow", 26.8467, 80.9462),
    ("Kanpur", 26.4499, 80.3319),
    ("Patna", 25.5941, 85.1376),
    ("Varanasi", 25.3176, 82.9739),
    ("Nagpur", 21.1458, 79.0882),
    ("Bhopal", 23.2599, 77.4126),
    ("Indore", 22.7196, 75.8577),
    ("Visakhapatnam", 17.6868, 83.2185),
    ("Coimbatore", 11.0168, 76.9558),
]
READING_TARGET_CITIES = [row[0] for row in READING_CITY_CENTRES]

# Open-data pollutant names.
OPEN_DATA_PARAMETERS = {
    "PM2.5": "pm25",
    "PM10": "pm10",
    "CO": "co",
    "NO2": "no2",
    "SO2": "so2",
    "OZONE": "o3",
    "O3": "o3",
}

# Header spellings of the offline backfill file.
BACKFILL_HEADERS = {
    "pm2.5": "pm25",
    "pm_25": "pm25",
    "pm_2_5": "pm25",
    "pm_10": "pm10",
    "ozone": "o3",
    "station": "station_name",
    "lat": "station_lat",
    "latitude": "station_lat",
    "lon": "station_lon",
    "lng": "station_lon",
    "longitude": "station_lon",
    "date": "timestamp",
    "datetime": "timestamp",
    "time": "timestamp",
}

# National PM2.5 index bands (c_lo, c_hi, i_lo, i_hi).
NATIONAL_PM25_BANDS = [
    (0.0, 30.0, 0.0, 50.0),
    (30.0, 60.0, 51.0, 100.0),
    (60.0, 90.0, 101.0, 200.0),
    (90.0, 120.0, 201.0, 300.0),
    (120.0, 250.0, 301.0, 400.0),
    (250.0, 500.0, 401.0, 500.0),
]

# EPA index bands (upper bound, offset, lower bound, index span, concentration span).
EPA_PM25_BANDS = [
    (12.0, 0.0, 0.0, 50.0, 12.0),
    (35.4, 50.0, 12.1, 50.0, 35.4 - 12.1),
    (55.4, 100.0, 35.5, 50.0, 55.4 - 35.5),
    (150.4, 150.0, 55.5, 50.0, 150.4 - 55.5),
    (250.4, 200.0, 150.5, 100.0, 250.4 - 150.5),
    (350.4, 300.0, 250.5, 100.0, 350.4 - 250.5),
    (500.4, 400.0, 350.5, 100.0, 500.4 - 350.5),
]
EPA_PM10_BANDS = [
    (54.0, 0.0, 0.0, 50.0, 54.0),
    (154.0, 50.0, 55.0, 50.0, 99.0),
    (254.0, 100.0, 155.0, 50.0, 99.0),
    (354.0, 150.0, 255.0, 50.0, 99.0),
    (424.0, 200.0, 355.0, 100.0, 69.0),
    (504.0, 300.0, 425.0, 100.0, 79.0),
    (604.0, 400.0, 505.0, 100.0, 99.0),
]

# Index category upper bounds and names.
EPA_CATEGORIES = [
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"),
    (300, "Very Unhealthy"),
]
EPA_LAST_CATEGORY = "Hazardous"

# National band upper bound, name and map colour.
NATIONAL_BANDS = [
    (50, "Good", "#00e400"),
    (100, "Satisfactory", "#ffff00"),
    (200, "Moderate", "#ff7e00"),
    (300, "Poor", "#ff0000"),
    (400, "Very Poor", "#99004c"),
]
NATIONAL_LAST_BAND = ("Severe", "#7e0023")

# Concentration that stands for a score of ten.
SCORE_MAX_CONCENTRATION = {
    "pm25": 150.0,
    "pm10": 300.0,
    "no2": 400.0,
    "so2": 400.0,
    "o3": 300.0,
    "co": 15.0,
}

# Uptake of one tree, planting density, buffers and index drop per thousand trees.
TREE_UPTAKE = {"pm25": 0.8, "pm10": 1.2, "no2": 1.4, "so2": 1.1, "co": 5.3}
TREE_CANOPY_M2 = 100.0
TREE_CO2_TONS = 0.022
TREE_CO2_KG = 22.0
TREE_BUFFERS = {"minimum": 1.0, "recommended": 1.2, "optimal": 1.5}
AQI_DROP_PER_1000 = {"pm25": 8.5, "pm10": 6.0, "no2": 4.0, "so2": 3.5, "co": 2.0, "o3": 3.0}
DEFAULT_AQI_DROP = 3.0
MATURITY_YEARS = 5
TREES_PER_HECTARE = 1000

# Yearly growth in percent per industry and urbanisation factor per city.
INDUSTRY_GROWTH = {
    "Steel": 2.5,
    "Cement": 2.0,
    "Power": 1.8,
    "Chemical": 3.0,
    "Textile": 1.5,
    "Automotive": 2.2,
    "Refinery": 2.8,
    "Mining": 2.4,
    "Pharmaceutical": 1.2,
    "Food Processing": 1.0,
    "Paper": 1.8,
    "Electronics": 0.8,
    "Other": 1.5,
}
DEFAULT_GROWTH = 1.5
CITY_URBANISATION = {
    "Mumbai": 1.03,
    "Delhi": 1.035,
    "Bangalore": 1.025,
    "Hyderabad": 1.028,
    "Chennai": 1.022,
    "Kolkata": 1.02,
    "Pune": 1.03,
    "Ahmedabad": 1.025,
    "Jaipur": 1.02,
    "Surat": 1.028,
    "Lucknow": 1.018,
    "Kanpur": 1.015,
    "Nagpur": 1.02,
    "Visakhapatnam": 1.025,
    "Vadodara": 1.022,
    "Ludhiana": 1.015,
    "Coimbatore": 1.02,
}
DEFAULT_URBANISATION = 1.02

# Default map centre when there is no coordinate at all.
DEFAULT_CENTRE = (20.5937, 78.9629)

# Marker colour per risk level, for the dashboard tables.
RISK_COLOURS = {"Low": "green", "Medium": "orange", "High": "red"}
DEFAULT_RISK_COLOUR = "blue"

# Control measures per risk level.
CONTROL_MEASURES = {
    "High": [
        "Install SO2 scrubbers",
        "Upgrade ESP (Electrostatic Precipitator) filters",
        "Weekly baghouse maintenance",
        "Continuous emissions monitoring system (CEMS)",
        "Automated alert system deployment",
        "Quarterly compliance audits",
    ],
    "Medium": [
        "Bi-weekly stack testing",
        "Monthly preventive burner tuning",
        "Shift-level leak detection walkthroughs",
        "Monthly air quality reports",
        "Enhanced maintenance schedules",
        "Semi-annual audits",
    ],
    "Low": [
        "Maintain compliance documentation",
        "Monthly calibration checks",
        "Standard maintenance schedules",
        "Annual third-party audit",
        "Quarterly emissions reports",
    ],
}

# Site advice per risk level, after the title-cased industry.
SITE_ADVICE = {
    "High": " site is high-risk. Install SO2 scrubbers and ESP filters, upgrade baghouse maintenance cadence to "
    "weekly, and deploy continuous emissions monitoring with automated alerts.",
    "Medium": " site is medium-risk. Increase stack testing to bi-weekly, perform preventive burner tuning, and add "
    "leak-detection walkthroughs each shift.",
    "Low": " site is low-risk. Maintain compliance logs, keep monthly calibration checks, and sustain preventive "
    "maintenance schedules.",
}
SERVICE_ADVICE = {
    "High": " site is HIGH RISK. Install SO2 scrubbers and ESP filters, upgrade baghouse maintenance to weekly, "
    "deploy continuous emissions monitoring with automated alerts, and conduct quarterly compliance audits.",
    "Medium": " site is MEDIUM RISK. Increase stack testing to bi-weekly, perform preventive burner tuning monthly, "
    "add leak-detection walkthroughs each shift, and maintain monthly air quality reports.",
    "Low": " site is LOW RISK. Maintain compliance logs, perform monthly calibration checks, sustain preventive "
    "maintenance schedules, and conduct annual third-party audits.",
}

# Rule table.  (condition, category, priority, action, pollutant, reduction, cost, timeline)
RULE_COLUMNS = [
    "condition", "category", "priority", "action", "pollutant",
    "estimated_reduction", "cost_category", "timeline",
]
RULES = [
    ("so2", "Emission Control", "Immediate", "Install wet scrubber / flue gas desulfurization (FGD) system",
     "so2", "60-80% SO2 reduction", "High", "3-6 months installation"),
    ("so2", "Emission Control", "Short-term", "Switch to low-sulfur fuel (< 0.5% sulfur content)",
     "so2", "20-40% SO2 reduction", "Medium", "1-2 months"),
    ("so2", "Monitoring", "Immediate", "Install continuous SO2 emissions monitoring system (CEMS)",
     "so2", "N/A", "Medium", "1-2 months"),
    ("pm", "Emission Control", "Immediate", "Install bag filter / fabric filter system",
     "pm25/pm10", "70-90% PM reduction", "High", "3-6 months installation"),
    ("pm", "Emission Control", "Short-term", "Electrostatic precipitator (ESP) for high-temperature processes",
     "pm25/pm10", "60-80% PM reduction", "High", "3-6 months installation"),
    ("pm10", "Emission Control", "Long-term", "Cyclone separator for coarse particulates (PM10)",
     "pm10", "40-60% PM10 reduction", "Medium", "6-12 months"),
    ("pm", "Monitoring", "Immediate", "Install real-time particulate matter sensor at stack",
     "pm25/pm10", "N/A", "Low", "1 month"),
    ("no2", "Emission Control", "Immediate", "Selective catalytic reduction (SCR) system",
     "no2", "70-90% NOx reduction", "High", "6-12 months"),
    ("no2", "Emission Control", "Short-term", "Low-NOx burner technology retrofit",
     "no2", "30-50% NOx reduction", "Medium", "3-6 months"),
    ("no2", "Emission Control", "Long-term", "Flue gas recirculation (FGR)",
     "no2", "10-20% NOx reduction", "Medium", "6-12 months"),
    ("no2", "Monitoring", "Immediate", "Install NOx CEMS at combustion sources",
     "no2", "N/A", "Low", "1-2 months"),
    ("co", "Process Optimization", "Immediate", "Optimize combustion air-fuel ratio",
     "co", "10-30% CO reduction", "Low", "1 month"),
    ("co", "Emission Control", "Short-term", "Install CO catalytic oxidizer",
     "co", "60-90% CO reduction", "Medium", "3-6 months"),
    ("co", "Maintenance", "Long-term", "Regular boiler/furnace maintenance schedule",
     "co", "10-20% CO reduction", "Low", "Ongoing"),
    ("co", "Monitoring", "Immediate", "CO detector network across facility",
     "co", "N/A", "Low", "1 month"),
    ("o3", "Process Optimization", "Immediate", "Reduce NOx and VOC precursor emissions",
     "o3", "10-30% O3 reduction", "Medium", "3-6 months"),
    ("o3", "Process Optimization", "Short-term", "Schedule high-emission operations at night",
     "o3", "5-10% O3 reduction", "Low", "1-2 months"),
    ("o3", "Monitoring", "Immediate", "Install ambient ozone monitoring station",
     "o3", "N/A", "Low", "1-2 months"),
    ("multiple", "Compliance", "Immediate", "Comprehensive emission audit within 30 days",
     "multiple", "N/A", "Medium", "1 month"),
    ("multiple", "Compliance", "Short-term", "Apply for pollution control extension if retrofitting",
     "multiple", "N/A", "Low", "1-2 months"),
    ("level:Medium", "Maintenance", "Short-term", "Preventive maintenance schedule for emission control equipment",
     "all", "N/A", "Low", "Quarterly"),
    ("level:Medium", "Monitoring", "Short-term", "Quarterly emission stack testing",
     "all", "N/A", "Low", "Quarterly"),
    ("level:Medium", "Training", "Short-term", "Employee environmental training program",
     "all", "N/A", "Low", "Annual"),
    ("level:Medium", "Audit", "Short-term", "Energy efficiency audit to reduce overall emissions",
     "all", "5-10% total reduction", "Low", "Annual"),
    ("level:Low", "Compliance", "Long-term", "Annual compliance review",
     "all", "N/A", "Low", "Annual"),
    ("level:Low", "Maintenance", "Long-term", "Maintain current emission control systems",
     "all", "N/A", "Low", "Ongoing"),
    ("level:Low", "Documentation", "Long-term", "Document best practices for ISO 14001 certification",
     "all", "N/A", "Low", "Annual"),
    ("industry:metal", "Industry-Specific", "Immediate",
     "Prioritize SO2 and PM controls, improve slag handling procedures",
     "so2/pm", "10-20% total reduction", "Medium", "3-6 months"),
    ("industry:chemical", "Industry-Specific", "Immediate", "Prioritize SO2, NO2, CO, and VOC controls",
     "so2/no2/co/voc", "15-25% total reduction", "High", "6-12 months"),
    ("industry:power", "Industry-Specific", "Immediate",
     "Prioritize SO2, NOx, PM controls, and carbon capture feasibility",
     "so2/nox/pm", "20-30% total reduction", "High", "12-24 months"),
    ("industry:cement", "Industry-Specific", "Immediate", "Prioritize PM10, PM2.5, and NOx controls",
     "pm10/pm25/nox", "15-25% total reduction", "High", "6-12 months"),
    ("industry:textile", "Industry-Specific", "Immediate",
     "Prioritize CO, VOC, and integrate wastewater co-treatment",
     "co/voc/wastewater", "10-20% total reduction", "Medium", "6-12 months"),
    ("industry:pharmaceutical", "Industry-Specific", "Immediate",
     "Prioritize VOC, CO, and hazardous waste handling",
     "voc/co/hazardous_waste", "10-20% total reduction", "High", "6-12 months"),
    ("industry:other", "Industry-Specific", "Short-term",
     "Apply general pollution control measures as per CPCB guidelines",
     "all", "5-10% total reduction", "Low", "6-12 months"),
]
INDUSTRY_RULE_GROUPS = {
    "steel": "metal",
    "metal": "metal",
    "metal_processing": "metal",
    "chemical": "chemical",
    "power": "power",
    "thermal": "power",
    "cement": "cement",
    "textile": "textile",
    "pharmaceutical": "pharmaceutical",
}

# Action families a site can need; used as labels of the action recommender.
ACTION_LABELS = ["SO2_Control", "PM_Control", "NOx_Control", "CO_Control", "O3_Control", "Audit"]

# Weights that rank rule-based and learned actions, and the label threshold.
RULE_WEIGHT = 0.7
LEARNED_WEIGHT = 0.3
LABEL_THRESHOLD = 0.4
