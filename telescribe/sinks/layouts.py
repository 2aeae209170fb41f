"""Viewer layouts: which ones the findings call for, and their JSON, built from one declarative catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The layout that a category calls for.
BY_CATEGORY = {
    "MOTION_STATE": "motion_control", "MOTION": "motion_control", "NAV_STUCK": "navigation", "NAVIGATION": "navigation", "NAVIGATION_STUCK": "navigation",
    "IMU_CALIBRATION": "imu", "IMU_ERROR": "imu", "IMU": "imu", "IMU_FROZEN": "imu", "IMU_HW_FIELD_ZERO": "imu", "LOCALIZATION": "localization", "LOCATION_STATE": "localization",
    "LOCALIZATION_STUCK": "localization", "SAFETY_STATE": "safety", "SAFETY": "safety", "BATTERY_STATE": "battery", "HW_FAULT": "hardware_fault", "HARDWARE_FAULT": "hardware_fault",
    "IR_SENSOR_DEAD": "hardware_fault", "FROZEN_SENSOR": "sensor_freeze", "SENSOR_FREEZE": "sensor_freeze", "FREEZE_ONSET": "sensor_freeze", "SENSOR_RESUME": "sensor_freeze",
    "ZERO_FIELD": "sensor_freeze", "UNSTABLE_FREQUENCY": "sensor_freeze", "DEPTH_CAMERA": "depth_camera", "DEPTH_CAMERA_ERROR": "depth_camera", "DEPTHCAM_FUSION_FAIL": "depth_camera",
    "DL_INFER_EVENT": "depth_camera", "ERROR": "abnormal_stop", "FAILURE": "abnormal_stop",
}
# Layouts where nothing else is called for.
BASE = ("abnormal_stop", "motion_control")
# Each layout's log search terms and plots (title, message paths).
VELOCITY = ("Linear Velocity", ("/cmd_vel.linear.x", "/chassis_cmd_vel.linear.x", "/odom.twist.twist.linear.x"))
TURNING = ("Angular Velocity", ("/cmd_vel.angular.z", "/chassis_cmd_vel.angular.z", "/odom.twist.twist.angular.z"))
EULER = ("IMU Euler Angles", ("/unbiased_imu_PRY.vector.x", "/unbiased_imu_PRY.vector.y", "/unbiased_imu_PRY.vector.z"))
POSE = ("Position", ("/localization/current_pose.pose.pose.position.x", "/localization/current_pose.pose.pose.position.y"))


def status(title: str, topic: str, *keys: str) -> tuple[str, tuple[str, ...]]:
    return title, tuple(f'{topic}.values[:]{{key=="{k}"}}.value' for k in keys)


STOP = status("Brake / Auto / E-Stop", "/device/all_device_status", "braker_down", "auto_mode", "emergency")
HEALTH = status("Health Flags", "/device/health_status", "imu_board", "motor_driver", "mcu_disconnection", "laser_disconnection")
CATALOGUE = {
    "motion_control": (("eco_decision",), (VELOCITY, TURNING, status("IMU Roll/Pitch", "/device/imu_data", "roll_angle", "pitch_angle"), STOP), ()),
    "battery": (("battery", "charge"), (status("Battery Level", "/device/battery", "level"), status("Voltage", "/device/battery", "voltage"), status("Cell Voltages", "/device/battery", *(f"cell_voltage_{i}" for i in range(1, 9))), status("Cell Temperatures", "/device/battery", *(f"cell_temperature_{i}" for i in range(1, 5)))), ()),
    "abnormal_stop": ((), (VELOCITY, STOP), ()),
    "imu": (("imu", "calibrat"), (EULER, status("Gyro", "/device/imu_data", "gyro_x", "gyro_y", "gyro_z"), HEALTH, ("Odometry", ("/odom.twist.twist.linear.x", "/odom.twist.twist.angular.z"))), ()),
    "navigation": (("stuck", "deadlock", "plan", "DijkstraSearch"), (VELOCITY, TURNING), ()),
    "hardware_fault": (("chassis", "fault", "motor"), (HEALTH, status("Odom Health", "/device/odom_status", "left_error", "right_error"), status("Connectivity", "/device/health_status", "router_disconnection", "tablet_disconnection"), status("Charger Current", "/device/battery", "charger_current")), ()),
    "localization": (("locali", "pose", "front_end"), (("Position X", POSE[1][:1]), ("Position Y", POSE[1][1:]), VELOCITY), ()),
    "sensor_freeze": (("still_flag", "freeze", "frozen"), (VELOCITY, EULER, POSE), ()),
    "docking": (("charge", "dock", "charger"), (("Approach Velocity", VELOCITY[1]), status("Battery / Charger", "/device/battery", "level", "charger_current")), ()),
    "safety": (("protector", "bumper", "emergency", "danger"), (status("Safety Status", "/device/all_device_status", "emergency", "protector"), VELOCITY), ()),
    "depth_camera": (("overdark", "dl_infer", "depthcam", "depth_pipeline"), (VELOCITY, POSE), ("/camera/color/image_raw", "/camera/depth/image_raw")),
}
COLORS = ("#0839f9", "#ef4107", "#16a34a", "#f59e0b", "#8b5cf6", "#06b6d4", "#ec4899", "#84cc16")


def selected(findings: DataFrame) -> DataFrame:
    """(layout): those that significant packets, or incidents (without a verdict), call for. findings: (category, severity, verdict)."""
    wanted = F.col("severity").isin("CRITICAL", "WARNING")
    if "verdict" in findings.columns:
        wanted = wanted | F.col("verdict").isin("CONFIRMED", "CONTRADICTED")
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in BY_CATEGORY.items() for x in pair]), F.col("category"))
    return findings.where(wanted).select(name.alias("layout")).where("layout is not null").distinct()


def layout(name: str) -> dict:
    """A layout's JSON: logs and raw messages and the scene on the left, plots and images on the right."""
    terms, plots, images = CATALOGUE[name]
    panels: dict[str, dict] = {
        f"RosOut!{name}": {"searchTerms": list(terms), "minLogLevel": 1, "reverseOrder": False},
        f"RawMessages!{name}": {"topicPath": "/device/all_device_status", "diffEnabled": False, "fontSize": 12},
        f"3D!{name}": {"followMode": "follow-pose", "cameraState": {"perspective": True, "distance": 15.0}, "topics": {t: {"visible": True} for t in ("/raw_scan", "/scan_rear", "/localization/current_pose", "/front_end_pose")}},
    }
    right = []
    for i, (title, paths) in enumerate(plots):
        panels[f"Plot!{name}{i}"] = {
            "foxglovePanelTitle": title, "paths": [{"value": p, "enabled": True, "timestampMethod": "receiveTime", "color": COLORS[k % len(COLORS)]} for k, p in enumerate(paths)],
            "showLegend": True, "isSynced": True, "xAxisVal": "timestamp",
        }
        right.append(f"Plot!{name}{i}")
    for i, topic in enumerate(images):
        panels[f"Image!{name}{i}"] = {"imageMode": {"imageTopic": topic}}
        right.append(f"Image!{name}{i}")
    split = lambda a, b, way, share: {"first": a, "second": b, "direction": way, "splitPercentage": share}
    column = right[-1]
    for k, pane in enumerate(reversed(right[:-1]), 2):
        column = split(pane, column, "column", round(100 / k, 1))
    left = split(f"RosOut!{name}", split(f"RawMessages!{name}", f"3D!{name}", "row", 20.0), "column", 30.0)
    return {"configById": panels, "globalVariables": {}, "userNodes": {}, "playbackConfig": {"speed": 1}, "layout": split(left, column, "row", 60.0)}


def layouts(findings: DataFrame | None, every: bool = False) -> dict[str, dict]:
    """The layouts' JSON by name: all, or those that findings call for, or the base ones. The catalogue bounds what is collected."""
    names = list(CATALOGUE) if every else sorted(r.layout for r in selected(findings).collect()) if findings is not None else []
    return {n: layout(n) for n in names or BASE}
