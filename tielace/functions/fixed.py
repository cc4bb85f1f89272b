"""Fixed values that results depend on."""

#: Cubic of the phase angle in degrees for the limb-darkening weight.
LIMB_CUBIC = (1.0, -1.9e-2, 2.42e-4, -1.46e-6)

#: Sphere radius in metres.
MOON_RADIUS_M = 1_737_400.0

#: Payload, preferred references in order, least and largest working resolution in metres.
REFERENCE_POLICY = (
    ("OHRC", ("NAC_L", "NAC_R"), 0.25, 4.0),
    ("TMC2_NADIR", ("NAC_L", "NAC_R", "KAGUYA_TC"), 2.0, 20.0),
    ("IIRS", ("KAGUYA_TC", "SLDEM_HILLSHADE", "WAC"), 10.0, 120.0),
    ("TMC2_FORE", ("NAC_L", "NAC_R", "KAGUYA_TC"), 2.0, 20.0),
    ("TMC2_AFT", ("NAC_L", "NAC_R", "KAGUYA_TC"), 2.0, 20.0),
    ("SYNTHETIC", ("SYNTHETIC",), 0.01, 1000.0),
)

#: The same for any other payload.
DEFAULT_POLICY = (("NAC_L",), 0.1, 200.0)

#: Payload, signal to noise, blur sigma (px), read noise, smear (px), stripe share, bits.
SENSOR_PROFILES = (
    ("OHRC", 100.0, 0.55, 0.004, 0.7, 0.0, 10),
    ("TMC2_NADIR", 90.0, 0.50, 0.005, 0.0, 0.0, 10),
    ("TMC2_FORE", 80.0, 0.55, 0.006, 0.0, 0.0, 10),
    ("TMC2_AFT", 80.0, 0.55, 0.006, 0.0, 0.0, 10),
    ("IIRS", 35.0, 0.70, 0.02, 0.0, 0.035, 12),
    ("NAC_L", 110.0, 0.45, 0.003, 0.3, 0.0, 12),
    ("NAC_R", 110.0, 0.45, 0.003, 0.3, 0.0, 12),
    ("KAGUYA_TC", 95.0, 0.50, 0.005, 0.0, 0.0, 10),
    ("WAC", 70.0, 0.60, 0.008, 0.0, 0.0, 10),
    ("SYNTHETIC", 1e6, 0.0, 0.0, 0.0, 0.0, 12),
)

#: Label quantities and the spellings of their keys, first spelling first.
LABEL_ALIASES = (
    ("sun_azimuth", ("sun_azimuth", "solar_azimuth", "sub_solar_azimuth", "sun_az", "solar_azimuth_angle")),
    ("sun_elevation", ("sun_elevation", "solar_elevation", "sun_elev", "solar_elevation_angle")),
    ("incidence", ("incidence_angle", "solar_incidence_angle", "incidence")),
    ("emission", ("emission_angle", "emmission_angle", "emission")),
    ("phase", ("phase_angle", "phase")),
    ("subsolar_lon", ("sub_solar_longitude", "subsolar_longitude")),
    ("subsolar_lat", ("sub_solar_latitude", "subsolar_latitude")),
    ("start_time", ("start_time", "start_date_time", "image_time", "observation_time", "product_creation_time")),
    ("product_id", ("product_id", "product_name", "logical_identifier", "image_id", "file_name")),
    ("instrument", ("instrument_id", "instrument_name", "instrument_host_id")),
    ("lines", ("lines", "image_lines", "line_samples_total", "number_of_lines")),
    ("samples", ("line_samples", "samples", "image_line_samples", "number_of_samples")),
    ("bands", ("bands", "band_count", "number_of_bands")),
    ("sample_bits", ("sample_bits", "bits_per_sample", "sample_bit_mask")),
    ("sample_type", ("sample_type", "data_type")),
    ("record_bytes", ("record_bytes",)),
    ("gsd", ("pixel_resolution", "map_scale", "spatial_resolution", "ground_sampling_distance", "resolution")),
    ("ul_lat", ("upper_left_latitude", "ul_corner_latitude", "corner_1_latitude", "north_west_latitude")),
    ("ul_lon", ("upper_left_longitude", "ul_corner_longitude", "corner_1_longitude", "north_west_longitude")),
    ("ur_lat", ("upper_right_latitude", "ur_corner_latitude", "corner_2_latitude", "north_east_latitude")),
    ("ur_lon", ("upper_right_longitude", "ur_corner_longitude", "corner_2_longitude", "north_east_longitude")),
    ("lr_lat", ("lower_right_latitude", "lr_corner_latitude", "corner_3_latitude", "south_east_latitude")),
    ("lr_lon", ("lower_right_longitude", "lr_corner_longitude", "corner_3_longitude", "south_east_longitude")),
    ("ll_lat", ("lower_left_latitude", "ll_corner_latitude", "corner_4_latitude", "south_west_latitude")),
    ("ll_lon", ("lower_left_longitude", "ll_corner_longitude", "corner_4_longitude", "south_west_longitude")),
)

#: Sample type and bits, and how NumPy reads them.
SAMPLE_TYPES = (
    ("lsb_integer", 8, "<i1"), ("lsb_integer", 16, "<i2"), ("lsb_integer", 32, "<i4"),
    ("msb_integer", 8, ">i1"), ("msb_integer", 16, ">i2"), ("msb_integer", 32, ">i4"),
    ("lsb_unsigned_integer", 8, "<u1"), ("lsb_unsigned_integer", 16, "<u2"), ("lsb_unsigned_integer", 32, "<u4"),
    ("msb_unsigned_integer", 8, ">u1"), ("msb_unsigned_integer", 16, ">u2"), ("msb_unsigned_integer", 32, ">u4"),
    ("unsigned_integer", 8, "|u1"), ("unsigned_integer", 16, "<u2"),
    ("integer", 8, "|i1"), ("integer", 16, "<i2"),
    ("ieee_real", 32, ">f4"), ("ieee_real", 64, ">f8"),
    ("pc_real", 32, "<f4"), ("pc_real", 64, "<f8"),
    ("real", 32, "<f4"),
)
