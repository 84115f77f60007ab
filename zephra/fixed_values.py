"""Names, thresholds, weights and texts that results depend on, stated as they must be."""

# --- missing values -------------------------------------------------------------------------------------------------
NULL_TOKENS = ["", "NA", "N/A", "na", "null", "None", "none", "nan", "NaN"]
FEED_NULL_TOKENS = ["NA"]

# --- columns --------------------------------------------------------------------------------------------------------
POLLUTANTS = ["PM2.5", "PM10", "NO2", "SO2", "CO", "OZONE", "NH3"]
FEED_INDEX = ["station", "city", "state", "latitude", "longitude", "last_update"]
SERIES_COLUMNS = ["station", "timestamp", *POLLUTANTS, "latitude", "longitude"]
MASTER_COLUMNS = ["station_name", "datetime", *POLLUTANTS, "AQI", "latitude", "longitude"]
REPORT_COLUMNS = [
    "Reference ID", "Timestamp", "Station", "Incident Type", "File Name",
    "AI Category", "AI Confidence", "Severity Score", "GPS Coords", "Status",
]
CITY_NAMES = ["bengaluru", "bangalore"]

# Header aliases, in the order in which they are tried.
SERIES_ALIASES = {
    "station": ["station", "station name", "station_name"],
    "timestamp": ["timestamp", "datetime", "last_update", "date", "date_time", "time"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng", "long"],
    "PM2.5": ["pm2.5", "pm2_5", "pm25", "pm 2.5", "pm2 5"],
    "PM10": ["pm10", "pm 10"],
    "NO2": ["no2"],
    "SO2": ["so2"],
    "CO": ["co"],
    "OZONE": ["ozone", "o3"],
    "NH3": ["nh3"],
}
MASTER_ALIASES = {
    "station_name": ["station_name", "station name", "station"],
    "datetime": ["datetime", "timestamp", "last_update", "date", "date_time"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng", "long"],
    "PM2.5": ["pm2.5", "pm2_5", "pm25", "pm 2.5", "pm2 5"],
    "PM10": ["pm10", "pm 10"],
    "NO2": ["no2"],
    "SO2": ["so2"],
    "CO": ["co"],
    "OZONE": ["ozone", "o3"],
    "NH3": ["nh3"],
    "AQI": ["aqi", "air quality index", "airqualityindex"],
}
WARD_NAME_PROPERTIES = [
    "KGISWardName", "WARD_NAME", "Ward_Name", "ward_name", "name", "NAME", "ASSEMBLY_N", "Ward_No",
]

# --- stations: name, latitude, longitude, aliases found in file names -----------------------------------------------
STATIONS = [
    ("BTM Layout, Bengaluru - CPCB", 12.913522, 77.595080, ["btmlayout", "blrbtmlayoutcpcb", "btm-layout"]),
    ("Silk Board, Bengaluru - KSPCB", 12.917348, 77.622813,
     ["centralsilkboard", "silkboard", "blrsilkboard", "silk-board"]),
    ("City Railway Station, Bengaluru - KSPCB", 12.975684, 77.566075,
     ["cityrailwaystation", "blrcityrailwaystation", "city-railway-station"]),
    ("Hebbal, Bengaluru - KSPCB", 13.029152, 77.585901, ["hebbal", "blrhebbal"]),
    ("Jayanagar 5th Block, Bengaluru - KSPCB", 12.920984, 77.584908,
     ["jayanagar5thblock", "blrjayanagar5thblock", "jayanagar-5th-block"]),
    ("Hombegowda Nagar, Bengaluru - KSPCB", 12.938539, 77.590100,
     ["hombegowdanagar", "blrhombegowdanagar", "hombegowda-nagar"]),
    ("Bapuji Nagar, Bengaluru - KSPCB", 12.951913, 77.539784, ["bapujinagar", "blrbapujinagar", "bapuji-nagar"]),
    ("Kasturi Nagar, Bengaluru - KSPCB", 13.003872, 77.664217, ["kasturinagar", "blrkasturinagar", "kasturi-nagar"]),
    ("Jigani, Bengaluru - KSPCB", 12.781628, 77.629915, ["jigani", "blrjigani"]),
    ("Peenya, Bengaluru - KSPCB", 13.030000, 77.520000, ["peenya", "blrpeenya", "peenyacpcb"]),
    ("RVCE Mailasandra, Bengaluru - KSPCB", 12.9232191, 77.5006464,
     ["rvcemailasandra", "blrrvcemailasandra", "mailasandra", "rvce-mailasandra"]),
    ("Sanegurava Halli, Bengaluru - KSPCB", 12.9904292, 77.5422438,
     ["saneguruvahalli", "saneguravahalli", "saneguruvanahalli", "blrsaneguravahalli", "saneguruva-halli"]),
    ("Shivapura Peenya, Bengaluru - KSPCB", 13.0160480, 77.5045057,
     ["shivapurapeenya", "blrshivapurapeenya", "shivapura-peenya"]),
    ("Kadubeesanahalli, Bengaluru - CPCB", 12.9389650, 77.6964066,
     ["kadubeesanahalli", "bwssbkadubeesanahalli", "blrkadubeesanahalli"]),
]
SITE_NAMES = {
    "site_162": "BTM Layout, Bengaluru - CPCB",
    "site_1553": "Bapuji Nagar, Bengaluru - KSPCB",
    "site_165": "City Railway Station, Bengaluru - KSPCB",
    "site_1554": "Hebbal, Bengaluru - KSPCB",
    "site_1556": "Jayanagar 5th Block, Bengaluru - KSPCB",
    "site_5729": "Jigani, Bengaluru - KSPCB",
    "site_5681": "Kasturi Nagar, Bengaluru - KSPCB",
    "site_163": "Peenya, Bengaluru - KSPCB",
    "site_5678": "RVCE Mailasandra, Bengaluru - KSPCB",
    "site_166": "Sanegurava Halli, Bengaluru - KSPCB",
    "site_5686": "Shivapura Peenya, Bengaluru - KSPCB",
    "site_1558": "Silk Board, Bengaluru - KSPCB",
}
EMPTY_STATIONS = ["site_165", "site_166"]

# --- labels ---------------------------------------------------------------------------------------------------------
BANDS = ["Good", "Moderate", "Poor", "Severe"]
SEASONS = ["monsoon", "summer", "winter"]

# --- clustering -----------------------------------------------------------------------------------------------------
MIN_SAMPLES = 3
# label, severity percentile, neighbour distance in degrees
SWEEPS = [("A", 60, 0.020), ("B", 60, 0.050), ("C", 40, 0.020), ("D", 40, 0.050)]
HOTSPOT_EPS_KM = 2.5
KM_PER_DEGREE = 111.0

# --- risk fusion: signal, label, weight -----------------------------------------------------------------------------
RISK_WEIGHTS = [
    ("sensor", "Ground AQI Sensors", 0.30),
    ("citizen", "Citizen Image AI", 0.25),
    ("satellite", "Satellite NO₂", 0.20),
    ("traffic", "Traffic Congestion", 0.15),
    ("meteorology", "Weather / Stagnation", 0.10),
]

# --- municipal response: branch, order, title, description, stars, cost, impact, department -------------------------
ACTIONS = [
    ("burning", 1, "Immediate Water Mist Cannon Deployment",
     "Deploy 2x mobile high-pressure water mist cannons to suppress particulate matter & smoke plumes.",
     "⭐⭐⭐⭐⭐ Critical", "₹1.2 Lakhs (Estimated)", "-14% PM2.5 (Estimated)", "BBMP Solid Waste & Sanitation Wing"),
    ("burning", 2, "Sanitation Clearing & Fire Containment",
     "Dispatch BBMP Sanitation Rapid Response team for immediate fire suppression and waste clearing.",
     "⭐⭐⭐⭐ High Priority", "₹0.8 Lakhs (Estimated)", "-6% PM2.5 (Estimated)", "BBMP Sanitation Wing"),
    ("burning", 3, "Ward Health Advisory & Sensor Placement",
     "Issue automated ward health warning for sensitive groups & deploy micro-sensor for tracking.",
     "⭐⭐⭐ Moderate", "₹0.5 Lakhs (Estimated)", "-4% Exposure (Estimated)", "Health & Environment Directorate"),
    ("industrial", 1, "Stack Emission Inspection & Compliance Check",
     "Mandate immediate stack emission compliance check on active industrial units in Peenya corridor.",
     "⭐⭐⭐⭐⭐ Critical", "₹2.0 Lakhs (Estimated)", "-10% NO₂ / PM (Estimated)",
     "KSPCB Regional Enforcement Inspectorate"),
    ("industrial", 2, "Heavy Diesel Commercial Transport Restriction",
     "Restrict heavy diesel freight transport during peak thermal inversion hours (06:00 - 10:00).",
     "⭐⭐⭐⭐ High Priority", "₹1.2 Lakhs (Estimated)", "-5% PM2.5 (Estimated)", "Bengaluru Traffic Police"),
    ("industrial", 3, "Industrial Buffer Dust Suppression Spraying",
     "Deploy misting vehicles along industrial boundary roads and unpaved buffer zones.",
     "⭐⭐⭐ Moderate", "₹1.0 Lakhs (Estimated)", "-3% PM2.5 (Estimated)", "BBMP Works Dept"),
    ("ambient", 1, "Intersection Anti-Smog Spray Operations",
     "Deploy anti-smog water spray cannons at major traffic bottlenecks and intersections.",
     "⭐⭐⭐⭐ High Priority", "₹1.8 Lakhs (Estimated)", "-8% PM2.5 (Estimated)", "Bengaluru Traffic Police"),
    ("ambient", 2, "Construction Site Dust Cover Enforcement",
     "Enforce mandatory construction dust suppression tarpaulins & perimeter water sprinkling.",
     "⭐⭐⭐⭐ High Priority", "₹1.0 Lakhs (Estimated)", "-4% Dust (Estimated)", "BBMP Works Dept"),
    ("ambient", 3, "Nighttime Mechanical Road Sweeping",
     "Deploy heavy mechanical road sweepers during night non-peak hours to clear road dust.",
     "⭐⭐⭐ Moderate", "₹0.7 Lakhs (Estimated)", "-3% Road Dust (Estimated)", "BBMP Sanitation Wing"),
]
# branch, department, budget, reduction, population
PLANS = [
    ("burning", "BBMP Solid Waste Management & Sanitation Wing", "₹2.5 Lakhs (Estimated)", "-24% PM2.5 (Estimated)",
     "48,500 Citizens (Estimated)"),
    ("industrial", "KSPCB Regional Inspectorate & Traffic Police", "₹4.2 Lakhs (Estimated)", "-18% PM2.5 (Estimated)",
     "62,000 Citizens (Estimated)"),
    ("ambient", "Bengaluru Traffic Police & BBMP Works Dept", "₹3.5 Lakhs (Estimated)", "-15% PM2.5 (Estimated)",
     "55,000 Citizens (Estimated)"),
]

# --- health advice: band, title, text -------------------------------------------------------------------------------
ADVISORIES = [
    ("Good", "🟢 Good Air Quality — Safe for Outdoor Activity",
     "Air quality is satisfactory. Safe for all outdoor activities and natural room ventilation."),
    ("Moderate", "🟡 Moderate Air Quality — Caution for Sensitive Groups",
     "Acceptable air quality. Children, elderly, and individuals with respiratory conditions (asthma) should reduce "
     "prolonged heavy outdoor exertion."),
    ("Poor", "🟠 Unhealthy Air Advisory — Sensitive Group Warning",
     "Unhealthy for sensitive groups. Limit outdoor activities; wear N95/KN95 masks near busy arterial roads and "
     "industrial corridors."),
    ("Severe", "🔴 Severe Pollution Health Warning",
     "Hazardous respiratory risk. Avoid outdoor physical exertion, keep windows closed, run indoor air purifiers, and "
     "wear N95 masks."),
]

# --- policy text ----------------------------------------------------------------------------------------------------
POLICY_INTRO = (
    "You are an urban air quality expert advising an MP's office in Bengaluru.\n"
    "Based on the following pollution hotspot data, provide a 2-3 sentence practical policy recommendation.\n"
    "State what likely causes the pollution (e.g. traffic, industrial, construction) and what intervention to "
    "prioritize (e.g. traffic signal timing, dust suppression, monitoring frequency).\n"
    "Make the recommendation highly actionable and specific to the given wards/stations if possible. Do not use "
    "markdown formatting like asterisks or bullet points.\n"
)
POLICY_FALLBACK = (
    "Likely pollution sources include heavy traffic, construction activity and industrial emissions. Increase roadside "
    "AQI monitoring, deploy water-mist cannons during peak hours, enforce dust suppression at construction sites, and "
    "conduct periodic industrial emission inspections."
)

# --- hotspot zone names and status texts ----------------------------------------------------------------------------
ZONES = {
    "north": "Dasarahalli & Peenya Industrial Belt",
    "southeast": "Silk Board - Electronic City Junction",
    "west": "Rajajinagar - Nayandahalli Belt",
    "centre": "Shivajinagar - Central Commercial Zone",
}
HIDDEN_LABEL = "🚨 UNMONITORED HIDDEN HOTSPOT"
MONITORED_LABEL = "⚠️ MONITORED HOTSPOT"
