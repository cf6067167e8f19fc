"""Fixed values of the radar data model."""

#: Gate sentinels and the bound above which a gate is valid.
MISSING, RANGE_FOLDED, VALID_ABOVE = -1000.0, -2000.0, -900.0
#: 4/3 earth radius, km, for column products; mean earth radius and its 4/3, m, for wind profiles; projection radius, km.
KE_A_KM = 8494.67
EARTH_M, EARTH_43_M, EARTH_KM = 6_371_000.0, 6_371_000.0 * 4.0 / 3.0, 6371.0
TILT_MERGE_DEG, PRODUCT_ROWS = 0.2, 720
ECHO_TOP_DBZ, VIL_CAP_DBZ, VIL_MIN_DBZ, VIL_MIN = 18.0, 56.0, 0.0, 0.1
ROT_TOP_KM, ROT_MIN_CREF = 2.0, 20.0
CELL_LEVELS, CELL_MIN_AREA_KM2, CELL_SEARCH_KM = (40.0, 50.0, 60.0), 8.0, 8.0
TDS_MIN_DBZ, TDS_MAX_RHO, TDS_MAX_ZDR, TDS_MIN_ROT, TDS_MIN_GATES, TDS_RADIUS_KM = 40.0, 0.80, 0.5, 10.0, 6, 3.0
PRIOR_MAX_AGE_S, PRIOR_ELEV_DEG = 900, 0.25
SEQUENCE_GAP_S, STORM_MOTION_AGE_S, MOSAIC_SKEW_S, MOSAIC_KM, NEIGHBOURS, TWIN_KM = 1800, 3600, 600, 900.0, 4, 6.0
TRACK_MATCH_KM, TRACK_NEW_KM, TRACK_GAP_S, TRACK_FRAMES, FORECAST_MIN, MESO, STRONG_MESO = 10.0, 15.0, 1200, 4, (15, 30, 45), 8.0, 15.0
LIVE_MIN, LIVE_MAX_MIN, AROUND_S = 60, 1440, 1800
RING_SIZE, RING_SPACING_S = 999, 150
QUOTA_BYTES, VOLUME_SHARE, WINDOW_STALE_MS = 20 * 1024**3, 0.85, 86_400_000
KNOTS, TRACK_MIN_ROT = 1.94384, 5.0
#: Azimuthal shear: arc to either side, m, most rays, least range, m, most scatter, m/s.
SHEAR_HALF_M, SHEAR_RADIALS, SHEAR_MIN_M, SHEAR_RESIDUAL_MS = 750.0, 10, 2000.0, 6.0
#: Specific phase: reach in heavy and light echo, m, heavy and least dBZ, least correlation, most scatter, degrees, its range.
KDP_HALF_M, KDP_HEAVY_DBZ, KDP_MIN_DBZ, KDP_MIN_RHO, KDP_RESIDUAL_DEG, KDP_LEAST, KDP_MOST = (1000.0, 3000.0), 40.0, 20.0, 0.9, 6.0, -2.0, 10.0
#: Bright band: elevations, degrees, ranges, m, correlation, dBZ, dB, least gates, most span of the middle half, m.
ML_ELEVATIONS, ML_RANGE_M, ML_RHO, ML_DBZ, ML_ZDR, ML_GATES, ML_DEPTH_IQR_M = (3.5, 10.5), (5000.0, 80_000.0), (0.90, 0.97), (30.0, 47.0), (0.8, 2.5), 300, 1000.0
