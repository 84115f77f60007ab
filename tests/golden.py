"""Published result rows that the jobs must reproduce."""

_NOTE = "adaptive (pre-2024: PM2.5 only; 2024+: weighted)"
# station, latitude, longitude, ward, PM2.5, PM10, severity, cluster
WARD_STATIONS = [
    ("BTM Layout, Bengaluru - CPCB", 12.913522, 77.59508, "Sarakki", 75.84, None, 75.84, 0),
    ("Bapuji Nagar, Bengaluru - KSPCB", 12.951913, 77.539784, "Gali Anjenaya Temple ward", 50.8, None, 50.8, -2),
    ("City Railway Station, Bengaluru - KSPCB", 12.975684, 77.566075, "Subhash Nagar", 85.85, None, 85.85, 1),
    ("Hebbal, Bengaluru - KSPCB", 13.029152, 77.585901, "Sanjaya Nagar", 65.47, None, 65.47, -2),
    ("Hombegowda Nagar, Bengaluru - KSPCB", 12.938539, 77.5901, "Ashoka Pillar", 68.09, None, 68.09, -2),
    ("Jayanagar 5th Block, Bengaluru - KSPCB", 12.920984, 77.584908, "Shakambari Nagar", 78.03, None, 78.03, 0),
    ("Jigani, Bengaluru - KSPCB", 12.781628, 77.629915, "Kalena Agrahara", 72.22, None, 72.22, -1),
    ("Kadubeesanahalli, Bengaluru - CPCB", 12.938965, 77.6964066, "Marathahalli", 72.77, None, 72.77, -1),
    ("Kasturi Nagar, Bengaluru - KSPCB", 13.003872, 77.664217, "Vijinapura", 98.2, None, 98.2, -1),
    ("Peenya, Bengaluru - KSPCB", 13.03, 77.52, "Peenya", 70.08, None, 70.08, -2),
    ("RVCE Mailasandra, Bengaluru - KSPCB", 12.9232191, 77.5006464, "Bande Mutt", 96.59, None, 96.59, -1),
    ("Sanegurava Halli, Bengaluru - KSPCB", 12.9904292, 77.5422438, "Basaveshwara Nagar", 86.77, None, 86.77, 1),
    ("Shivapura Peenya, Bengaluru - KSPCB", 13.016048, 77.5045057, "Nelagadderanahalli", 70.78, None, 70.78, 1),
    ("Silk Board, Bengaluru - KSPCB", 12.917348, 77.622813, "Jakkasandra", 77.02, None, 77.02, 0),
    ("site_1553", 12.951913, 77.539784, "Gali Anjenaya Temple ward", 34.21, 74.97, 45.78, -2),
    ("site_1554", 13.029152, 77.585901, "Sanjaya Nagar", 29.15, 62.46, 39.04, -2),
    ("site_1556", 12.920984, 77.584908, "Shakambari Nagar", 33.89, 70.53, 43.61, -2),
    ("site_1558", 12.917348, 77.622813, "Jakkasandra", 31.35, 107.44, 52.7, -2),
    ("site_162", 12.913522, 77.59508, "Sarakki", 24.13, 63.14, 35.85, -2),
    ("site_163", 13.03, 77.52, "Peenya", 28.49, 69.52, 41.46, -2),
    ("site_5678", 12.9232191, 77.5006464, "Bande Mutt", 42.2, 101.65, 60.91, -2),
    ("site_5681", 13.003872, 77.664217, "Vijinapura", 34.53, 74.34, 46.16, -2),
    ("site_5686", 13.016048, 77.5045057, "Nelagadderanahalli", 32.08, 73.47, 44.03, -2),
    ("site_5729", 12.781628, 77.629915, "Kalena Agrahara", 35.41, 73.7, 46.53, -2),
]
# run, candidates, clusters, noise
SWEEP_RESULTS = {"A": (10, 0, 10), "B": (10, 2, 4), "C": (14, 1, 11), "D": (14, 1, 6)}
# cluster, wards, latitude, longitude, severity, PM2.5, stations
CLUSTERS = [
    (1, "Subhash Nagar, Basaveshwara Nagar, Nelagadderanahalli", 12.992678, 77.539675, 81.1333, 81.1333,
     "City Railway Station, Bengaluru - KSPCB; Sanegurava Halli, Bengaluru - KSPCB; Shivapura Peenya, Bengaluru - KSPCB"),
    (0, "Sarakki, Shakambari Nagar, Jakkasandra", 12.91732, 77.600893, 76.9633, 76.9633,
     "BTM Layout, Bengaluru - CPCB; Jayanagar 5th Block, Bengaluru - KSPCB; Silk Board, Bengaluru - KSPCB"),
]
AREAS = {
    "Cluster 1", "Cluster 0", "Standalone - Kasturi Nagar", "Standalone - RVCE Mailasandra",
    "Standalone - Kadubeesanahalli", "Standalone - Jigani",
}
# first reading, last reading, readings, PM2.5 missing, its share, PM10 missing, its share, mean gap in hours
QUALITY = [
    ("2022-11-01 00:00:00", "2023-12-31 23:00:00", 9552, 3593, 37.61515912897823, 9552, 100.0, 1.0703591244444444),
    ("2018-06-01 00:00:00", "2023-12-31 23:00:00", 48336, 7415, 15.34053293611387, 48336, 100.0, 1.0129098994444443),
    ("2024-01-01 00:00:00", "2025-12-31 23:45:00", 70176, 8094, 11.533857729138166, 8769, 12.495725034199728, 0.25),
]
# feature, importance, share, running share
IMPORTANCE = [
    ("roll7", 0.40204605848775643, 40.205, 40.2),
    ("roll30", 0.33583374897005924, 33.583, 73.79),
    ("month", 0.0581397676199886, 5.814, 79.6),
    ("day_of_week", 0.057384399766243196, 5.738, 85.34),
    ("is_hotspot_zone", 0.019402740721787676, 1.94, 87.28),
    ("season_monsoon", 0.016786677309286645, 1.679, 88.96),
    ("ward_name_Bande Mutt", 0.015148653710744324, 1.515, 90.47),
    ("season_winter", 0.009797183678730845, 0.98, 91.45),
    ("ward_name_Sarakki", 0.009372696617336706, 0.937, 92.39),
    ("ward_name_Gali Anjenaya Temple ward", 0.009250106950236333, 0.925, 93.32),
    ("ward_name_Marathahalli", 0.008104611926810605, 0.81, 94.13),
    ("ward_name_Peenya", 0.006671250310140485, 0.667, 94.79),
    ("season_summer", 0.006605138633410856, 0.661, 95.45),
    ("ward_name_Vijinapura", 0.006459452845573209, 0.646, 96.1),
    ("ward_name_Basaveshwara Nagar", 0.00586637095228147, 0.587, 96.69),
    ("ward_name_Shakambari Nagar", 0.005230556391751753, 0.523, 97.21),
    ("ward_name_Sanjaya Nagar", 0.004918068966134111, 0.492, 97.7),
    ("ward_name_Nelagadderanahalli", 0.004895067456318864, 0.49, 98.19),
    ("ward_name_Kalena Agrahara", 0.004739856045519496, 0.474, 98.67),
    ("ward_name_Jakkasandra", 0.004619660982231559, 0.462, 99.13),
    ("ward_name_Ashoka Pillar", 0.004580305718128924, 0.458, 99.59),
    ("ward_name_Subhash Nagar", 0.004147625939528734, 0.415, 100.0),
]
REPORTS = [
    ("ARG-2026-9B41A", "2026-07-06 10:15:00", "Silk Board, Bengaluru - KSPCB", "Garbage Burning", "incident_smoke_01.jpg",
     "Garbage Burning", "94.2%", "82 / 100", "12.9172, 77.6228", "Verified"),
    ("ARG-2026-1E50F", "2026-07-06 07:55:00", "BTM Layout, Bengaluru - CPCB", "Vehicle Exhaust", "road_haze.jpg",
     "Road Dust", "76.4%", "54 / 100", "12.9166, 77.6101", "Pending"),
]
